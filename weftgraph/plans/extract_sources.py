"""Source files that the extraction queries read, and what must be found in them.

One template per language, ``§`` standing for a supplier's number. Beside each stands what
must be found in it: symbols as ``kind name first-last`` (lines), containment as
``outer / inner``, references as ``source -> kind target [hint]``; the file node has the
name of the file. Spaces in names are spelled as underscores.

The lists were taken from what the extractors give and read over one by one against the
sources (which showed one error, since mended). So the queries on them hold results fast;
they are no independent derivation.
"""

from __future__ import annotations

#: Symbols, containment and references of each language.
SYMBOLS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "rust": (
        "s§/tally.rs",
        """use std::fmt::Debug;
/// Counts things.
pub struct Tally§ { pub total: u64 }
pub enum Unit§ { Gram, Kilo }
pub trait Weigh§ {
    fn weigh(&self) -> u64;
}
impl Tally§ {
    pub fn add§(&mut self, n: u64) {
        self.total = sum§(self.total, n);
    }
}
impl Weigh§ for Tally§ {
    fn weigh(&self) -> u64 {
        let s = Scale§::new();
        s.read();
        self.total
    }
}
type Load§ = u64;
fn sum§(a: u64, b: u64) -> u64 { a + b } // never§()
""",
        (
            "file tally.rs 1-21",
            "struct Tally§ 3-3",
            "enum Unit§ 4-4",
            "trait Weigh§ 5-7",
            "method weigh 6-6",
            "namespace impl_Tally§ 8-12",
            "method add§ 9-11",
            "namespace impl_Weigh§_for_Tally§ 13-19",
            "method weigh 14-18",
            "type_alias Load§ 20-20",
            "function sum§ 21-21",
            "field total 3-3",
            "enum_member Gram 4-4",
            "enum_member Kilo 4-4",
            "import std::fmt::Debug 1-1",
            "tally.rs / Tally§",
            "tally.rs / Unit§",
            "tally.rs / Weigh§",
            "Weigh§ / weigh",
            "tally.rs / impl_Tally§",
            "impl_Tally§ / add§",
            "tally.rs / impl_Weigh§_for_Tally§",
            "impl_Weigh§_for_Tally§ / weigh",
            "tally.rs / Load§",
            "tally.rs / sum§",
            "Tally§ / total",
            "Unit§ / Gram",
            "Unit§ / Kilo",
            "tally.rs / std::fmt::Debug",
            "impl_Weigh§_for_Tally§ -> implements Weigh§",
            "tally.rs -> imports std::fmt::Debug",
            "add§ -> calls sum§",
            "weigh -> calls new [!Scale§]",
            "weigh -> calls read [Scale§]",
        ),
    ),
    "javascript": (
        "s§/jar.js",
        """import { lid } from './lid§.js';
class Jar§ extends Pot {
  fill§(n) {
    return pour§(n);
  }
}
function pour§(n) {
  Tap§.open('no§()');
  return new Drop§(n);
}
const shake§ = (n) => {
  pour§(n);
};
""",
        (
            "file jar.js 1-13",
            "class Jar§ 2-6",
            "method fill§ 3-5",
            "function pour§ 7-10",
            "function shake§ 11-13",
            "import ./lid§.js 1-1",
            "jar.js / Jar§",
            "Jar§ / fill§",
            "jar.js / pour§",
            "jar.js / shake§",
            "jar.js / ./lid§.js",
            "Jar§ -> extends Pot",
            "jar.js -> imports ./lid§.js",
            "fill§ -> calls pour§",
            "pour§ -> calls open [!Tap§]",
            "pour§ -> instantiates Drop§",
            "shake§ -> calls pour§",
        ),
    ),
    "typescript": (
        "s§/jar.ts",
        """export interface Shape§ { area(): number }
export enum Size§ { Small, Large }
export type Id§ = string;
export class Box§ implements Shape§ {
  async area() {
    return this.side§();
  }
  side§(): number {
    return 2;
  }
}
""",
        (
            "file jar.ts 1-11",
            "interface Shape§ 1-1",
            "enum Size§ 2-2",
            "type_alias Id§ 3-3",
            "class Box§ 4-11",
            "method area 5-7",
            "method side§ 8-10",
            "enum_member Small 2-2",
            "enum_member Large 2-2",
            "jar.ts / Shape§",
            "jar.ts / Size§",
            "jar.ts / Id§",
            "jar.ts / Box§",
            "Box§ / area",
            "Box§ / side§",
            "Size§ / Small",
            "Size§ / Large",
            "Box§ -> implements Shape§",
            "area -> calls side§ [Self]",
        ),
    ),
    "python": (
        "s§/mill.py",
        '''import os
from grain import sack§


class Mill§(Wheel):
    """Grinds."""

    def turn§(self, stone: Stone§):
        self.stop§()
        stone.spin()
        return weigh§(1)

    def stop§(self):
        Brake§.pull()


def weigh§(n):
    return n
''',
        (
            "file mill.py 1-18",
            "import os 1-1",
            "import grain.sack§ 2-2",
            "class Mill§ 5-14",
            "method turn§ 8-11",
            "method stop§ 13-14",
            "function weigh§ 17-18",
            "mill.py / os",
            "mill.py / grain.sack§",
            "mill.py / Mill§",
            "Mill§ / turn§",
            "Mill§ / stop§",
            "mill.py / weigh§",
            "mill.py -> imports os",
            "mill.py -> imports grain.sack§",
            "Mill§ -> extends Wheel",
            "turn§ -> calls stop§ [Self]",
            "turn§ -> calls spin [Stone§]",
            "turn§ -> calls weigh§",
            "stop§ -> calls pull [!Brake§]",
        ),
    ),
    "go": (
        "s§/loom.go",
        """package loom

import "errors"

type Loom§ struct {
	Width int
}

func (l *Loom§) Weave§() int {
	return knot§(l.Width)
}

func knot§(n int) int {
	return n
}
""",
        (
            "file loom.go 1-15",
            "struct Loom§ 5-7",
            "method Weave§ 9-11",
            "function knot§ 13-15",
            "field Width 6-6",
            "import errors 3-3",
            "loom.go / Loom§",
            "loom.go / Weave§",
            "loom.go / knot§",
            "Loom§ / Width",
            "loom.go / errors",
            "loom.go -> imports errors",
            "Weave§ -> calls knot§",
        ),
    ),
    "java": (
        "s§/Press.java",
        """package press;
import java.util.List;
public class Press§ extends Engine implements Sold§ {
  private int half§(int n) {
    return n / 2;
  }
  public int run§(int n) {
    Dial§.reset();
    new Juice§();
    return half§(n);
  }
}
interface Sold§ {
  void sell();
}
enum Grade§ { FIRST, SECOND }
""",
        (
            "file Press.java 1-16",
            "class Press§ 3-12",
            "method half§ 4-6",
            "method run§ 7-11",
            "interface Sold§ 13-15",
            "method sell 14-14",
            "enum Grade§ 16-16",
            "enum_member FIRST 16-16",
            "enum_member SECOND 16-16",
            "import java.util.List 2-2",
            "Press.java / Press§",
            "Press§ / half§",
            "Press§ / run§",
            "Press.java / Sold§",
            "Sold§ / sell",
            "Press.java / Grade§",
            "Grade§ / FIRST",
            "Grade§ / SECOND",
            "Press.java / java.util.List",
            "Press§ -> extends Engine",
            "Press§ -> implements Sold§",
            "Press.java -> imports java.util.List",
            "run§ -> calls reset [!Dial§]",
            "run§ -> instantiates Juice§",
            "run§ -> calls half§",
        ),
    ),
    "c": (
        "s§/gear.c",
        """#include "spring.h"
struct gear§ { int teeth; };
static int ratio§(int a) {
  return a; /* no§() */
}
int tick§(int n) {
  return ratio§(n);
}
""",
        (
            "file gear.c 1-8",
            "struct gear§ 2-2",
            "function ratio§ 3-5",
            "function tick§ 6-8",
            "import spring.h 1-1",
            "gear.c / gear§",
            "gear.c / ratio§",
            "gear.c / tick§",
            "gear.c / spring.h",
            "gear.c -> imports spring.h",
            "tick§ -> calls ratio§",
        ),
    ),
    "cpp": (
        "s§/face.cpp",
        """#include <vector>
namespace clock§ {
class Face§ : public Plate {
public:
  int draw();
};
int clamp§(int a) {
  return a;
}
int Face§::draw() {
  return clamp§(9);
}
}
""",
        (
            "file face.cpp 1-13",
            "namespace clock§ 2-13",
            "class Face§ 3-6",
            "function clamp§ 7-9",
            "method draw 10-12",
            "import vector 1-1",
            "face.cpp / clock§",
            "clock§ / Face§",
            "clock§ / clamp§",
            "clock§ / draw",
            "face.cpp / vector",
            "Face§ -> extends Plate",
            "face.cpp -> imports vector",
            "draw -> calls clamp§",
        ),
    ),
    "csharp": (
        "s§/Oven.cs",
        """using Bakery.Flour;
namespace Bakery§ {
  public class Oven§ : IHeat {
    public int Warm§() {
      Dial§.Turn();
      return Check§(4);
    }
    private int Check§(int n) {
      return n;
    }
  }
}
""",
        (
            "file Oven.cs 1-12",
            "namespace Bakery§ 2-12",
            "class Oven§ 3-11",
            "method Warm§ 4-7",
            "method Check§ 8-10",
            "import Bakery.Flour 1-1",
            "Oven.cs / Bakery§",
            "Bakery§ / Oven§",
            "Oven§ / Warm§",
            "Oven§ / Check§",
            "Oven.cs / Bakery.Flour",
            "Oven§ -> implements IHeat",
            "Oven.cs -> imports Bakery.Flour",
            "Warm§ -> calls Turn [!Dial§]",
            "Warm§ -> calls Check§",
        ),
    ),
    "php": (
        "s§/Stamp.php",
        """<?php
class Stamp§ extends Label implements Priced {
  public function frank§() {
    return $this->mark§(1);
  }
  private function mark§($n) {
    return Ink§::dry($n);
  }
}
""",
        (
            "file Stamp.php 1-9",
            "class Stamp§ 2-9",
            "method frank§ 3-5",
            "method mark§ 6-8",
            "Stamp.php / Stamp§",
            "Stamp§ / frank§",
            "Stamp§ / mark§",
            "Stamp§ -> extends Label",
            "Stamp§ -> implements Priced",
            "frank§ -> calls mark§ [Self]",
            "mark§ -> calls dry [!Ink§]",
        ),
    ),
    "swift": (
        "s§/Bed.swift",
        """import Soil
struct Seed§ { var depth: Int }
class Bed§: Sown {
  func sprout§() -> Int {
    return water§(2)
  }
  func water§(_ n: Int) -> Int {
    return Can§.pour(n)
  }
}
""",
        (
            "file Bed.swift 1-10",
            "struct Seed§ 2-2",
            "class Bed§ 3-10",
            "method sprout§ 4-6",
            "method water§ 7-9",
            "import Soil 1-1",
            "Bed.swift / Seed§",
            "Bed.swift / Bed§",
            "Bed§ / sprout§",
            "Bed§ / water§",
            "Bed.swift / Soil",
            "Bed§ -> implements Sown",
            "Bed.swift -> imports Soil",
            "sprout§ -> calls water§",
            "water§ -> calls pour [!Can§]",
        ),
    ),
    "kotlin": (
        "s§/Shed.kt",
        """import garden.Rake
class Shed§ : Locked {
  fun open§(): Int {
    return this.swing§(1)
  }
  fun swing§(n: Int): Int {
    return Hinge§.oil(n)
  }
}
""",
        (
            "file Shed.kt 1-9",
            "class Shed§ 2-9",
            "method open§ 3-5",
            "method swing§ 6-8",
            "import garden.Rake 1-1",
            "Shed.kt / Shed§",
            "Shed§ / open§",
            "Shed§ / swing§",
            "Shed.kt / garden.Rake",
            "Shed§ -> implements Locked",
            "Shed.kt -> imports garden.Rake",
            "open§ -> calls swing§ [Self]",
            "swing§ -> calls oil [!Hinge§]",
        ),
    ),
    "dart": (
        "s§/kite.dart",
        """import 'package:kite/line.dart';
class Kite§ extends Toy {
  int climb§(int n) {
    return pull§(n);
  }
  int pull§(int n) {
    return n;
  }
}
""",
        (
            "file kite.dart 1-9",
            "class Kite§ 2-9",
            "method climb§ 3-5",
            "method pull§ 6-8",
            "import package:kite/line.dart 1-1",
            "kite.dart / Kite§",
            "Kite§ / climb§",
            "Kite§ / pull§",
            "kite.dart / package:kite/line.dart",
            "Kite§ -> extends Toy",
            "kite.dart -> imports package:kite/line.dart",
            "climb§ -> calls pull§",
        ),
    ),
    "ruby": (
        "s§/anvil.rb",
        """require 'iron'
module Forge§
  class Anvil§ < Block
    def strike§(n)
      ring§(n)
    end
    def ring§(n)
      Mould§.pour(n)
    end
  end
end
""",
        (
            "file anvil.rb 1-11",
            "module Forge§ 2-11",
            "class Anvil§ 3-10",
            "method strike§ 4-6",
            "method ring§ 7-9",
            "import iron 1-1",
            "anvil.rb / Forge§",
            "Forge§ / Anvil§",
            "Anvil§ / strike§",
            "Anvil§ / ring§",
            "anvil.rb / iron",
            "Anvil§ -> extends Block",
            "strike§ -> calls ring§",
            "ring§ -> calls pour [!Mould§]",
            "anvil.rb -> imports iron",
        ),
    ),
    "elisp": (
        "s§/tea.el",
        """(defvar tea-§ 4 "Steep.")
(defun tea-pour-§ (cup)
  (tea-fill-§ cup)) ; (no-§)
""",
        (
            "file tea.el 1-3",
            "variable tea-§ 1-1",
            "function tea-pour-§ 2-3",
            "tea.el / tea-§",
            "tea.el / tea-pour-§",
            "tea-pour-§ -> calls cup",
            "tea-pour-§ -> calls tea-fill-§",
        ),
    ),
    "commonlisp": (
        "s§/ink.lisp",
        """(defpackage :quill§)
(defstruct nib§ width)
(defun dip§ (nib)
  (wet§ nib))
""",
        (
            "file ink.lisp 1-4",
            "module quill§ 1-1",
            "struct nib§ 2-2",
            "function dip§ 3-4",
            "ink.lisp / quill§",
            "ink.lisp / nib§",
            "ink.lisp / dip§",
            "dip§ -> calls nib",
            "dip§ -> calls wet§",
        ),
    ),
    "scheme": (
        "s§/bell.scm",
        """(define pitch§ 440)
(define (toll§ n)
  (strike§ pitch§ n))
""",
        (
            "file bell.scm 1-3",
            "variable pitch§ 1-1",
            "function toll§ 2-3",
            "bell.scm / pitch§",
            "bell.scm / toll§",
            "toll§ -> calls strike§",
        ),
    ),
    "svelte": (
        "s§/Lamp.svelte",
        """<p>dim§()</p>
<script>
function glow§(n) {
  return n;
}
function burn§() {
  return glow§(3);
}
</script>
""",
        (
            "file Lamp.svelte 1-9",
            "function glow§ 3-5",
            "function burn§ 6-8",
            "Lamp.svelte / glow§",
            "Lamp.svelte / burn§",
            "burn§ -> calls glow§",
        ),
    ),
    "vue": (
        "s§/Lamp.vue",
        """<template><b>x</b></template>
<script lang="ts">
function trim§(n: number) {
  cut§(n);
}
</script>
""",
        (
            "file Lamp.vue 1-6",
            "function trim§ 3-5",
            "Lamp.vue / trim§",
            "trim§ -> calls cut§",
        ),
    ),
}

#: Calls through variables whose types are told by their declarations.
RECEIVERS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "rust": (
        "s§/r.rs",
        """fn go§(c: &Cart§) {
    let w = Wagon§::new();
    let b: Box§ = make();
    c.roll();
    w.halt();
    b.lift();
    x.none();
}
""",
        (
            "go§ -> calls new [!Wagon§]",
            "go§ -> calls make",
            "go§ -> calls roll [Cart§]",
            "go§ -> calls halt [Wagon§]",
            "go§ -> calls lift [Box§]",
            "go§ -> calls none",
        ),
    ),
    "javascript": (
        "s§/r.js",
        """function go§() {
  const c = new Cart§();
  c.roll();
  x.none();
}
""",
        (
            "go§ -> calls roll [Cart§]",
            "go§ -> calls none",
        ),
    ),
    "python": (
        "s§/r.py",
        """def go§(w: Wagon§):
    c = Cart§()
    b: Box§ = make()
    c.roll()
    w.halt()
    b.lift()
    x.none()
""",
        (
            "go§ -> calls Cart§",
            "go§ -> calls make",
            "go§ -> calls roll [Cart§]",
            "go§ -> calls halt [Wagon§]",
            "go§ -> calls lift [Box§]",
            "go§ -> calls none",
        ),
    ),
    "java": (
        "s§/R.java",
        """class R§ {
  void go§(Wagon§ w) {
    Cart§ c = new Cart§();
    c.roll();
    w.halt();
    this.none();
  }
}
""",
        (
            "go§ -> calls roll [Cart§]",
            "go§ -> calls halt [Wagon§]",
            "go§ -> calls none [Self]",
        ),
    ),
    "kotlin": (
        "s§/r.kt",
        """fun go§(w: Wagon§) {
  val c = Cart§()
  c.roll()
  w.halt()
  super.none()
}
""",
        (
            "go§ -> calls Cart§",
            "go§ -> calls roll [Cart§]",
            "go§ -> calls halt [Wagon§]",
            "go§ -> calls none [Self]",
        ),
    ),
    "csharp": (
        "s§/R.cs",
        """class R§ {
  void Go§(Wagon§ w) {
    var c = new Cart§();
    c.Roll();
    w.Halt();
    base.None();
  }
}
""",
        (
            "Go§ -> calls Roll [Cart§]",
            "Go§ -> calls Halt [Wagon§]",
            "Go§ -> calls None [Self]",
        ),
    ),
}

#: Routes of web frameworks and their handlers.
ROUTES: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "javascript": (
        "s§/app.js",
        """app.get('/jars/§', listJars§);
router.post('/jars', auth, pour§);
store.get('no§');
""",
        (
            "GET_/jars/§ 1",
            "POST_/jars 2",
            "GET_/jars/§ -> references listJars§",
            "POST_/jars -> references pour§",
        ),
    ),
    "typescript": (
        "s§/app/jars§/route.ts",
        """export function GET() {}
@Put('/lids/§')
seal() {}
""",
        (
            "ANY_/jars§ 1",
            "PUT_/lids/§ 2",
        ),
    ),
    "python": (
        "s§/urls.py",
        """urlpatterns = [path('mill/§/', views.grind§)]
@bp.delete('/sack/§')
def drop():
    pass
""",
        (
            "ANY_mill/§/ 1",
            "DELETE_/sack/§ 2",
            "ANY_mill/§/ -> references grind§",
        ),
    ),
    "ruby": (
        "s§/routes.rb",
        """  get '/forge/§', to: 'forge#light'
  post '/anvil', to: 'anvil#strike'
""",
        (
            "GET_/forge/§ 1",
            "POST_/anvil 2",
        ),
    ),
    "php": (
        "s§/web.php",
        """Route::post('/stamp/§', 'StampController@frank');
#[Route('/ink/§')]
""",
        (
            "POST_/stamp/§ 1",
            "ANY_/ink/§ 2",
        ),
    ),
    "go": (
        "s§/mux.go",
        """func wire(r Mux) {
	r.GET("/loom/§", weave§)
	e.PUT("/knot", tie§)
}
""",
        (
            "GET_/loom/§ 2",
            "PUT_/knot 3",
            "GET_/loom/§ -> references weave§",
            "PUT_/knot -> references tie§",
        ),
    ),
    "java": (
        "s§/Ctrl.java",
        """@GetMapping("/press/§")
public String list() { return null; }
@RequestMapping("/juice")
class C {}
""",
        (
            "GET_/press/§ 1",
            "ANY_/juice 3",
        ),
    ),
    "csharp": (
        "s§/Ctrl.cs",
        """[HttpDelete("/oven/§")]
public void Cool() { }
""",
        (
            "DELETE_/oven/§ 1",
        ),
    ),
    "kotlin": (
        "s§/Ctrl.kt",
        """@PostMapping("/shed/§")
fun open() {}
""",
        (
            "POST_/shed/§ 1",
        ),
    ),
}

#: Files that do not parse, and the numbers of errors and of missing closings.
BROKEN: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "rust": (
        "s§/b.rs",
        """fn a§() { {
""",
        (
            "errors 0",
            "missing 2",
        ),
    ),
    "go": (
        "s§/b.go",
        """package b
func a§() { } }
""",
        (
            "errors 1",
            "missing 0",
        ),
    ),
    "python": (
        "s§/b.py",
        """def ok§():
    pass

def bad(:
    pass
""",
        (
            "errors 1",
            "missing 0",
        ),
    ),
    "scheme": (
        "s§/b.scm",
        """(define (a§ n)) ))
""",
        (
            "errors 2",
            "missing 0",
        ),
    ),
    "ruby": (
        "s§/b.rb",
        """def a§
  1
end
end
""",
        (
            "errors 1",
            "missing 0",
        ),
    ),
    "java": (
        "s§/B.java",
        """class B§ { void a() { }
""",
        (
            "errors 0",
            "missing 1",
        ),
    ),
}
