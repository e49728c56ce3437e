"""The labelled table of web pages that the main-text classifier is trained on."""

from __future__ import annotations

import numpy as np

PAGES = 800


def labelled_pages(pages: int = PAGES, seed: int = 11) -> list[str]:
    """Pages made by a rule with a fixed seed, whose main content stands in elements marked ``data-main``.

    Most of them say what is what by HTML's own elements (article, main, nav, aside, footer,
    form); the rest are plain div, p, table cells and lists, so that only word counts, link
    densities and neighbours tell an article from menus, adverts, notices, related links,
    comments and footers. Articles hold headings, short paragraphs and lists between
    longer ones, and lines of links where the elements mark the article; some pages have
    an article and nothing else.
    """
    rng = np.random.default_rng(seed)

    def some(low: int, high: int) -> str:
        return " ".join("word" * int(k) for k in rng.integers(1, 3, int(rng.integers(low, high + 1))))

    def one(*choices):
        return choices[int(rng.integers(len(choices)))]

    def chance(p: float) -> bool:
        return bool(rng.random() < p)

    def link(low: int, high: int) -> str:
        return f"<a href=x>{some(low, high)}</a>"

    def menu() -> str:
        n = int(rng.integers(3, 11))
        form = int(rng.integers(3))
        if form == 0:
            return "<ul>" + "".join(f"<li>{link(1, 3)}</li>" for _ in range(n)) + "</ul>"
        if form == 1:
            return "<div>" + " | ".join(link(1, 2) for _ in range(n)) + "</div>"
        return "".join(f"<div>{link(1, 3)}</div>" for _ in range(n))

    def advert() -> str:
        return f"<div>{some(3, 14) if chance(0.6) else link(3, 12)}</div>"

    def notice() -> str:
        return f"<div>{some(8, 22)} {link(1, 3)}</div>"

    def paragraph(low: int, high: int) -> str:
        inner = some(low, high)
        if chance(0.2):
            inner += f" {link(1, 3)} {some(max(1, low // 2), high)}"
        return f"<p>{inner}</p>"

    def article(marked: bool = False) -> str:
        parts = [f"<{(h := one('h1', 'h2'))}>{some(2, 12)}</{h}>"] if chance(0.9) else []
        for k in range(int(rng.integers(2, 10))):
            form = rng.random()
            if marked and chance(0.4):  # where elements say what is what, a line of links is no menu
                parts.append(f"<p>{link(1, 12)}</p>" if chance(0.6) else "<ul>" + "".join(f"<li>{link(1, 3)}</li>" for _ in range(3)) + "</ul>")
            elif form < 0.62 or k == 0:
                parts.append(paragraph(14, 130))
            elif form < 0.78:
                parts.append(paragraph(1, 9))
            elif form < 0.86:
                parts.append(f"<h3>{some(1, 7)}</h3>" + paragraph(14, 90))
            elif form < 0.94:
                parts.append("<ul>" + "".join(f"<li>{some(1, 18)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
            else:
                parts.append(f"<blockquote>{some(6, 40)}</blockquote>")
        if chance(0.7):
            parts.append(paragraph(14, 110))
        return "".join(parts)

    def related() -> str:
        head = f"<{(h := one('h3', 'h4', 'div'))}>{some(1, 3)}</{h}>" if chance(0.7) else ""
        return head + "".join(f"<{(t := one('li', 'p', 'div'))}>{link(3, 12)}</{t}>" for _ in range(int(rng.integers(2, 7))))

    def comments() -> str:
        return f"<div>{some(1, 3)}</div>" + "".join(f"<div>{link(1, 2)} {some(1, 3)}</div><div>{some(3, 30)}</div><div>{link(1, 2)}</div>" for _ in range(int(rng.integers(1, 5))))

    def footer() -> str:
        return f"<div>{some(3, 12)}</div>" + (f"<div>{' '.join(link(1, 2) for _ in range(int(rng.integers(2, 6))))}</div>" if chance(0.6) else "")

    out = []
    for k in range(pages):
        if k % 16 == 1:
            out.append(f"<body><div data-main>{article()}</div></body>")
        elif k % 3:  # said by elements
            main = one("article", "main")
            inside = f"<aside>{one(related, advert)()}</aside>" if chance(0.3) else ""
            short = f"<p>{some(1, 12)}</p>" if chance(0.3) else article(True)
            out.append(
                f"<body><header>{f'<h1>{some(1, 4)}</h1>' if chance(0.5) else ''}<nav>{menu()}</nav></header>{advert() if chance(0.7) else ''}"
                f"<{main} data-main>{short}{inside}</{main}>"
                f"{f'<aside>{related()}</aside>' if chance(0.5) else ''}{comments() if chance(0.5) else ''}{f'<p>{some(20, 60)}</p>' if chance(0.3) else ''}<form><label>{some(1, 4)}</label><p>{some(5, 30)}</p></form><footer>{footer()}</footer></body>"
            )
        else:
            before = "".join(part for part in (menu(), f"<div>{some(1, 4) if chance(0.5) else link(1, 3)}</div>" if chance(0.3) else "", advert() if chance(0.4) else ""))
            after = "".join(part for part in (f"<div>{' '.join(link(1, 1) for _ in range(3))}</div>" if chance(0.4) else "", related() if chance(0.5) else "", comments() if chance(0.3) else "", notice() if chance(0.3) else "", menu() if chance(0.3) else "", footer()))
            if chance(0.2):
                out.append(f"<table><tr><td>{before}</td><td data-main>{article()}</td></tr></table>{after}")
            else:
                out.append(f"<body>{before}<div data-main>{article()}</div>{after}</body>")
    return out
