"""Extractors: what each language's sources must give; routes; files that no extractor may fall over."""

import time

import pytest

from weftgraph.sources.extract import EXTRACTORS, extract, extract_file

# One source per language: path, text, symbols (kind, name) and calls (name, receiver hint) that must be found.
# Words ending in "_text" stand in comments and strings and must never be found.
SOURCES = {
    "rust": (
        "kiln/src/oven.rs",
        """use std::fmt::Display;

/// Holds the bricks of one firing.
pub struct Batch { pub bricks: usize, heat: f32 }

pub enum Glaze { Matt, Ash }

pub trait Fire { fn light(&self); }

impl Batch {
    pub fn cool(&mut self) { self.heat = lower(self.heat); /* warm_text() */ }
    fn count(&self) -> usize { self.bricks }
}

impl Fire for Batch {
    fn light(&self) { let log = Ledger::begin("open_text()"); log.note(); }
}

fn lower(h: f32) -> f32 { h / 2.0 }
""",
        {("struct", "Batch"), ("field", "bricks"), ("enum", "Glaze"), ("enum_member", "Ash"), ("trait", "Fire"), ("method", "cool"), ("method", "light"), ("function", "lower"), ("import", "std::fmt::Display")},
        {("lower", None), ("begin", "!Ledger"), ("note", "Ledger")},
    ),
    "python": (
        "mill/grind.py",
        """import os.path
from grain import Sack

class Mill(Wheel):
    '''Turns wheat_text() into flour.'''
    def turn(self, sack: Sack):
        self.brake()
        sack.empty()
        return weigh(len(sack))

    @staticmethod
    async def brake():
        Lever.pull()

def weigh(n, unit=default_unit()):
    return [scale(x) for x in range(n)]
""",
        {("class", "Mill"), ("method", "turn"), ("method", "brake"), ("function", "weigh"), ("import", "os.path"), ("import", "grain.Sack")},
        {("brake", "Self"), ("empty", "Sack"), ("weigh", None), ("pull", "!Lever"), ("default_unit", None), ("scale", None)},
    ),
    "javascript": (
        "ferry/dock.js",
        """import { tide } from '../sea/tide.js';
const rope = require("hemp");
class Ferry extends Boat {
  moor(at) { return tie(at); }
}
function tie(at) { Signal.raise('lower_text()'); return new Knot(at); }
const cast = async (off) => { await tie(off); }; // drift_text()
""",
        {("class", "Ferry"), ("method", "moor"), ("function", "tie"), ("function", "cast"), ("import", "../sea/tide.js"), ("import", "hemp")},
        {("tie", None), ("raise", "!Signal")},
    ),
    "typescript": (
        "ferry/berth.ts",
        """export interface Berth { length: number; free(): boolean }
export enum Side { Port, Starboard }
export type Metres = number;
export class Quay implements Berth {
  private depth = 4;
  async free() { return this.measure() > 2; }
  measure(): number { return this.depth; }
}
""",
        {("interface", "Berth"), ("enum", "Side"), ("enum_member", "Starboard"), ("type_alias", "Metres"), ("class", "Quay"), ("method", "free"), ("method", "measure")},
        {("measure", "Self")},
    ),
    "go": (
        "loom/warp.go",
        """package loom

import (
	"errors"
	thread "fibre/thread"
)

type Loom struct {
	Width int
}

type Weaver interface { Weave() error }

func (l *Loom) Weave() error { return tension(l.Width) }

func tension(w int) error { return errors.New("snap_text()") }
""",
        {("struct", "Loom"), ("field", "Width"), ("interface", "Weaver"), ("method", "Weave"), ("function", "tension"), ("import", "errors"), ("import", "fibre/thread")},
        {("tension", None)},
    ),
    "java": (
        "orchard/Press.java",
        """package orchard;
import orchard.fruit.Pear;
public class Press extends Machine implements Cleanable, Sellable<Juice> {
  private int halve(int pears) { return pears / 3; } // rinse_text()
  public Juice run(int pears) { Meter.reset(); return new Juice(halve(pears)); }
}
interface Cleanable { void clean(); }
enum Grade { FIRST, SECOND }
""",
        {("class", "Press"), ("method", "halve"), ("method", "run"), ("interface", "Cleanable"), ("enum", "Grade"), ("import", "orchard.fruit.Pear")},
        {("halve", None), ("reset", "!Meter")},
    ),
    "c": (
        "clock/gear.c",
        """#include "spring.h"
struct gear { int teeth; };
enum state { WOUND, RUN_DOWN };
static int ratio(int a, int b) { return a / b; /* slip_text(); */ }
int tick(struct gear *g) { puts("tock_text()"); return ratio(g->teeth, 12); }
""",
        {("struct", "gear"), ("enum", "state"), ("function", "ratio"), ("function", "tick"), ("import", "spring.h")},
        {("ratio", None), ("puts", None)},
    ),
    "cpp": (
        "clock/face.cpp",
        """#include <vector>
namespace clockwork {
class Face : public Plate {
public:
  void draw();
};
struct Hand { int angle; };
int clamp(int a) { return a % 360; }
void Face::draw() { turn(clamp(90)); } // hide_text()
}
""",
        {("namespace", "clockwork"), ("class", "Face"), ("struct", "Hand"), ("function", "clamp"), ("method", "draw"), ("import", "vector")},
        {("clamp", None), ("turn", None)},
    ),
    "csharp": (
        "bakery/Oven.cs",
        """using Bakery.Flour;
namespace Bakery {
  public interface IHeat { void Warm(); }
  public class Oven : Appliance, IHeat {
    public void Warm() { Dial.Turn("ring_text()"); Check(4); }
    private bool Check(int n) => n > 3;
  }
}
""",
        {("namespace", "Bakery"), ("interface", "IHeat"), ("class", "Oven"), ("method", "Warm"), ("method", "Check"), ("import", "Bakery.Flour")},
        {("Turn", "!Dial"), ("Check", None)},
    ),
    "php": (
        "post/Stamp.php",
        """<?php
namespace Post;
use Post\\Paper\\Sheet;
interface Priced { }
class Stamp extends Label implements Priced {
  public function frank() { return $this->mark('burn_text()'); } // tear_text()
  private function mark($ink) { return Ink::dry($ink); }
}
""",
        {("namespace", "Post"), ("interface", "Priced"), ("class", "Stamp"), ("method", "frank"), ("method", "mark")},
        {("mark", "Self"), ("dry", "!Ink")},
    ),
    "swift": (
        "garden/Bed.swift",
        """import Soil
protocol Sown { func sprout() }
struct Seed { var depth: Int }
class Bed: Sown {
  func sprout() { water(2) } // weed_text()
  func water(_ n: Int) -> Int { return Can.pour(n) }
}
""",
        {("protocol", "Sown"), ("struct", "Seed"), ("class", "Bed"), ("method", "sprout"), ("method", "water"), ("import", "Soil")},
        {("water", None), ("pour", "!Can")},
    ),
    "kotlin": (
        "garden/Shed.kt",
        """import garden.tools.Rake
interface Locked { fun unlock() }
class Shed : Locked {
  override fun unlock() { this.swing(1) } // jam_text()
  private fun swing(n: Int) = Hinge.oil(n)
}
""",
        {("interface", "Locked"), ("class", "Shed"), ("method", "unlock"), ("method", "swing"), ("import", "garden.tools.Rake")},
        {("swing", "Self"), ("oil", "!Hinge")},
    ),
    "dart": (
        "kite/kite.dart",
        """import 'package:kite/line.dart';
class Kite extends Toy {
  int climb(int wind) { return pull(wind); } // dive_text()
  int pull(int n) => n * 2;
}
""",
        {("class", "Kite"), ("method", "climb"), ("method", "pull")},
        {("pull", None)},
    ),
    "ruby": (
        "forge/anvil.rb",
        """require 'iron'
module Forge
  class Anvil < Block
    def strike(n)
      ring(n) if n > 1
    end

    def self.cast
      Mould.pour(1)
    end
  end
end # shout_text()
""",
        {("module", "Forge"), ("class", "Anvil"), ("method", "strike"), ("method", "cast"), ("import", "iron")},
        {("ring", None), ("pour", "!Mould")},
    ),
    "elisp": ("tea.el", '(require \'kettle)\n(defcustom tea-minutes 4 "Steep. pour-text")\n(defun tea-pour (cup) (tea--fill cup)) ; (spill-text)\n(defmacro tea-with (x) x)\n', {("variable", "tea-minutes"), ("function", "tea-pour"), ("function", "tea-with")}, {("tea--fill", None)}),
    "commonlisp": ("ink.lisp", "(defpackage :quill)\n(defstruct nib width)\n(defconstant +depth+ 3)\n(defun dip (nib) (wet nib +depth+)) #| (blot-text) |#\n", {("module", "quill"), ("struct", "nib"), ("constant", "+depth+"), ("function", "dip")}, {("wet", None)}),
    "scheme": ("bell.scm", "(define pitch 440)\n(define (toll n) (strike pitch n)) ; (crack-text)\n(define peal (lambda (n) (toll n)))\n", {("variable", "pitch"), ("function", "toll"), ("function", "peal")}, {("strike", None), ("toll", None)}),
    "svelte": ("Lamp.svelte", "<p>dim_text()</p>\n\n<script>\nimport Wick from './Wick.svelte';\nfunction glow(n) { return n; }\nfunction burn() { return glow(3); }\n</script>\n", {("function", "glow"), ("function", "burn"), ("import", "./Wick.svelte")}, {("glow", None)}),
    "vue": ("Lamp.vue", "<template><b>dim_text()</b></template>\n<script setup lang=\"ts\">\nfunction trim(w: number) { cut(w); }\n</script>\n", {("function", "trim")}, {("cut", None)}),
}


@pytest.mark.parametrize("language", sorted(EXTRACTORS))
def test_sources(language):
    path, text, symbols, calls = SOURCES[language]
    found = extract_file(path, language, text)
    assert found.nodes[0]["kind"] == "file" and found.nodes[0]["language"] == language
    assert symbols <= {(n["kind"], n["name"]) for n in found.nodes}
    got = {(r["target_name"], r["receiver_hint"]) for r in found.refs if r["kind"] == "calls"}
    assert calls <= got
    assert not [t for t, _ in got if t.endswith(("_text", "-text"))]
    assert found.parse_errors == found.parse_missing == 0
    ids = {n["id"] for n in found.nodes}
    assert all(e["source"] in ids and e["target"] in ids for e in found.edges)
    assert all(r["source_node_id"] in ids for r in found.refs)


def named(language):
    path, text, *_ = SOURCES[language]
    found = extract_file(path, language, text)
    return {n["name"]: n for n in found.nodes}, {(r["kind"], r["target_name"]) for r in found.refs}, found


def test_lines_documentation_and_visibility():
    by, refs, _ = named("rust")
    assert by["Batch"]["docstring"] == "Holds the bricks of one firing." and by["Batch"]["is_exported"] and not by["lower"]["is_exported"]
    assert by["cool"]["qualified_name"] == "kiln/src/oven.rs::impl Batch::cool" and (by["impl Batch"]["start_line"], by["impl Batch"]["end_line"]) == (10, 13)
    assert ("implements", "Fire") in refs
    by, refs, _ = named("java")
    assert refs >= {("extends", "Machine"), ("implements", "Cleanable"), ("implements", "Sellable"), ("instantiates", "Juice"), ("imports", "orchard.fruit.Pear")}
    assert by["halve"]["is_exported"] is False and by["run"]["is_exported"] is True
    by, refs, _ = named("python")
    assert by["brake"]["is_static"] and by["brake"]["is_async"] and by["Mill"]["docstring"] == "Turns wheat_text() into flour." and ("extends", "Wheel") in refs
    assert by["turn"]["end_line"] == 9
    by, _, _ = named("svelte")
    assert by["glow"]["start_line"] == 5
    assert named("csharp")[1] >= {("implements", "Appliance"), ("implements", "IHeat")}
    assert named("ruby")[0]["cast"]["is_static"] and ("extends", "Block") in named("ruby")[1]


def test_scopes_and_inferred_receivers():
    source = "fn outer() {\n    fn inner() { deep(); }\n    let cart = Cart::new();\n    cart.roll();\n}\nfn other(c: &Wagon) { c.halt(); }\n"
    found = extract_file("w.rs", "rust", source)
    name = {n["id"]: n["name"] for n in found.nodes}
    calls = {(name[r["source_node_id"]], r["target_name"], r["receiver_hint"]) for r in found.refs if r["kind"] == "calls"}
    assert calls >= {("inner", "deep", None), ("outer", "roll", "Cart"), ("other", "halt", "Wagon")}
    source = "class Till:\n    def open(self):\n        drawer = Drawer()\n        drawer.slide()\n        def later():\n            self.close()\n"
    found = extract_file("t.py", "python", source)
    name = {n["id"]: n["name"] for n in found.nodes}
    calls = {(name[r["source_node_id"]], r["target_name"], r["receiver_hint"]) for r in found.refs if r["kind"] == "calls"}
    assert calls >= {("open", "slide", "Drawer"), ("later", "close", "Self")}


def test_broken_files():
    found = extract_file("b.py", "python", "def whole():\n    return 1\n\ndef torn(:\n    pass\n")
    assert found.parse_errors == 1 and any(n["name"] == "whole" for n in found.nodes)
    assert extract_file("b.rs", "rust", "fn a() { {").parse_missing == 2
    assert extract_file("b.go", "go", "func a() { } }").parse_errors == 1
    assert extract_file("x.cob", "cobol", "x") is None


DEEP = {
    "lists in lists": ("scheme", "d.scm", "(f " * 3_000 + ")" * 3_000),
    "a long sum": ("python", "d.py", "def g():\n    return 1\nx = " + "+".join(["f(1)"] * 5_000)),
    "many signs": ("python", "d.py", "def g():\n    return 1\nx = " + "-" * 20_000 + "1"),
    "many brackets": ("python", "d.py", "def g():\n    return 1\nx = " + "(" * 20_000),
    "nested calls": ("python", "d.py", "def g():\n    return 1\nx = " + "f(" * 80 + ")" * 80),
    "a chain of attributes": ("python", "d.py", "def g():\n    return 1\nx = a" + ".b()" * 3_000),
    "open braces": ("rust", "d.rs", "fn g() {" * 3_000),
    "open calls": ("javascript", "d.js", "app.get('/x', " * 3_000),
}


@pytest.mark.parametrize("what", sorted(DEEP))
def test_no_file_ends_a_job(what):
    language, path, text = DEEP[what]
    began = time.perf_counter()
    found = extract_file(path, language, text)
    assert found.nodes[0]["kind"] == "file" and time.perf_counter() - began < 60
    if language == "python":
        assert any(n["name"] == "g" for n in found.nodes)
    if language == "scheme":
        assert len([r for r in found.refs if r["target_name"] == "f"]) == 3_000


def test_an_extractor_that_fails_leaves_the_file_node(monkeypatch):
    def fail(*_):
        raise RecursionError

    monkeypatch.setitem(EXTRACTORS, "go", fail)
    found = extract_file("a.go", "go", "package a\n")
    assert [n["kind"] for n in found.nodes] == ["file"] and found.parse_errors == 1


def test_whole_signatures_and_arguments():
    many = ", ".join(f"argument_{k}: SomeLongType{k}" for k in range(100))
    found = extract_file("s.rs", "rust", f"pub fn wide({many}) -> u8 {{ 1 }}")
    assert next(n for n in found.nodes if n["name"] == "wide")["signature"].endswith("argument_99: SomeLongType99) -> u8")
    listed = " ".join(f"parameter-{k}" for k in range(100))
    found = extract_file("s.scm", "scheme", f"(define (wide {listed}) 1)")
    assert next(n for n in found.nodes if n["name"] == "wide")["signature"].endswith("parameter-99) 1)")
    steps = ", ".join(f"step{k}" for k in range(1_000))
    found = extract_file("s.js", "javascript", f"router.post('/kiln', {steps}, fireUp);\n")
    assert [r["target_name"] for r in found.refs if r["kind"] == "references"] == ["fireUp"]


# Language, path, text, and the routes with their handlers that it registers.
ROUTES = [
    ("ruby", "conf/routes.rb", "Rails.draw do\n  delete '/kilns/:id', to: 'kilns#douse'\nend\n", {"DELETE /kilns/:id": None}),
    ("ruby", "kiln.rb", "  delete '/kilns/:id', to: 'kilns#douse'\n", {}),
    ("go", "srv/mux.go", 'e.PUT("/loom/:w", reweave)\nother.PUT("/no", nothing)\n', {"PUT /loom/:w": "reweave"}),
    ("csharp", "Oven.cs", '[HttpPatch("/oven/{id}")]\npublic IResult Warm(int id) {}\n[Route("/oven")]\n', {"PATCH /oven/{id}": None, "ANY /oven": None}),
    ("python", "shop.py", "@bp.delete('/mill')\ndef stop(): ...\n@api.route(\"/flour\", methods=['POST'])\ndef sell(): ...\n", {"DELETE /mill": None, "ANY /flour": None}),
    ("python", "mill/urls.py", "urlpatterns = [\n    path('grind/<int:n>/', views.grind),\n    re_path(r'^sack$', sacks),\n]\n", {"ANY grind/<int:n>/": "grind", "ANY ^sack$": "sacks"}),
    ("php", "routes/api.php", "Route::patch('/stamp', [StampController::class, 'frank']);\n", {"PATCH /stamp": "class"}),
    ("php", "StampController.php", "#[Route('/ink', name: 'ink')]\nclass A {}\n", {"ANY /ink": None}),
    ("java", "Press.java", '@RequestMapping("/press")\nclass Press {\n@PutMapping("/press/{n}")\nJuice run() {}\n}\n', {"ANY /press": None, "PUT /press/{n}": None}),
    ("kotlin", "Shed.kt", '@PatchMapping("/shed")\nfun open() {}\n', {"PATCH /shed": None}),
    ("javascript", "ferry.js", "fastify.put(`/berth`, { schema }, moorAt);\nlocker.put('/x', y);\n", {"PUT /berth": "moorAt"}),
    ("typescript", "dock.controller.ts", "@Patch('/dock')\nmoor() {}\n", {"PATCH /dock": None}),
    ("typescript", "/site/pages/api/tide/index.ts", "export default () => 1\n", {"ANY /tide": None}),
    ("typescript", "/site/app/harbour/wall/route.ts", "export const POST = f\n", {"ANY /harbour/wall": None}),
]


@pytest.mark.parametrize("language,path,text,routes", ROUTES, ids=[f"{r[0]}-{r[1]}" for r in ROUTES])
def test_routes(language, path, text, routes):
    found = extract_file(path, language, text)
    nodes = {n["id"]: n["name"] for n in found.nodes if n["kind"] == "route"}
    handlers = {nodes[r["source_node_id"]]: r["target_name"] for r in found.refs if r["kind"] == "references"}
    assert {name: handlers.get(name) for name in nodes.values()} == routes


def test_the_table_function(spark):
    rows = [(path, language, text) for language, (path, text, *_) in SOURCES.items()] + [("e.rs", "rust", ""), ("n.py", "python", None), ("u.txt", "unknown", "x"), *[(f"{k}{path}", language, text) for k, (language, path, text) in enumerate(DEEP.values())]]
    got = extract(spark.createDataFrame(rows, "path string, language string, text string")).collect()
    assert len(got) == len(SOURCES) + 2 + len(DEEP)
    assert {r["path"]: len(r["nodes"]) for r in got}["e.rs"] == 1
