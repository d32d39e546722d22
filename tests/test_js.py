"""Facts of JavaScript sources, and the operators over them."""

import random

import pytest

from quarrel.operators import flow
from quarrel.sources import js

SOURCE = """// a comment with { brackets (
import React, { useState as state, memo } from "react";
import * as path from './lib/path';
import type { Shape } from "./shape";
import "./side";
const lazy = () => import('./lazy');
const fs = require("fs");

export function pick(a, b) {
  if (a && b) { return a; } else if (b) { return b } else { throw new TypeError("x" + `${a ? "`}" : 2}`); }
  console.log("never");
}

export default class Box extends Base {
  size = 3;
  constructor(w: Width) { super(); this.w = w ?? 1 }
  async fill(n) {
    for (const x of n) { if (!x) continue; if (x > 9) break; this.w += x }
    return /[/"]+/.test(n) ? 1 : 0;
  }
}

const twice = x => x * 2, walk = (t) => {
  outer: while (true) {
    do { t = t.next } while (t && t.ok);
    switch (t.kind) { case 1: case 2: step(t); break; case "three": return; default: break outer }
  }
  try { risky() } catch (e) { Log.warn(e) } finally { done() }
  return t
  ;
}
export { twice, walk as default2 };
export * from './all';
export const one = 1, two = 2;
module.exports.extra = new Widget();
"""


@pytest.fixture(scope="module")
def found(spark):
    return js.facts(spark.createDataFrame([("m.ts", SOURCE), ("bad.js", "function f( {\n"), ("none.js", None)], "path string, content string")).cache()


def test_tokens():
    t, bad = js.scan("a = b / c / d; /x[/]\\/y/g.test(s); `a${`b${1}`}}` // end")
    assert not bad and [x.text for x in t if x.kind in ("regex", "template")] == ["/x[/]\\/y/g", "`a${`b${1}`}}`"]
    assert js.scan("f(\n[)")[1] == 1 and js.scan("}\n")[1] == 1 and js.scan("")[0] == []


def test_imports_and_exports(found):
    rows = {(r.kind, r.name, r.detail, r.source) for r in found.where("path = 'm.ts'").collect()}
    assert {(k, n, d, s) for k, n, d, s in rows if k.startswith("import")} == {("import_import", "default", "React", "react"), ("import_import", "useState", "state", "react"), ("import_import", "memo", "memo", "react"), ("import_import", "*", "path", "./lib/path"), ("import_type_only", "Shape", "Shape", "./shape"), ("import_side_effect", "", "", "./side"), ("import_dynamic", "", "", "./lazy"), ("import_require", "", "", "fs")}
    assert {(k, n, d) for k, n, d, _ in rows if k.startswith("export")} == {("export_named", "pick", "Function"), ("export_default", "default", "Class"), ("export_named", "twice", "list"), ("export_named", "default2", "list"), ("export_all", "*", "re_export"), ("export_named", "one", "Variable"), ("export_named", "two", "Variable"), ("export_commonjs", "extra", "")}
    assert {(d, n) for k, n, d, _ in rows if k == "dep"} == {("new", "TypeError"), ("new", "Widget"), ("type", "Base"), ("type", "Width"), ("call", "Log"), ("call", "t")} - {("call", "t")}
    idents = {n for k, n, _, _ in rows if k == "ident"}
    assert "memo" not in idents and "fs" in idents and "next" not in idents
    errors = [(r.path, r.line) for r in found.where("kind = 'error'").collect()]
    assert errors == [("bad.js", 1)] and found.where("path = 'none.js' and kind <> 'block' and kind <> 'edge'").count() == 1


def test_functions_complexity_and_nesting(found):
    rows = {r.name: r for r in found.where("path = 'm.ts' and kind = 'function'").collect()}
    assert set(rows) == {"<module>", "lazy", "pick", "Box.constructor", "Box.fill", "twice", "walk"}
    assert (rows["pick"].line, rows["pick"].end_line) == (9, 12) and rows["pick"].a == 1
    assert rows["Box.fill"].b == 2 and rows["pick"].b == 1 and rows["walk"].b == 2
    blocks, edges, _ = js.flow_tables(found.where("path = 'm.ts'"))
    extras = found.where("kind = 'function'").selectExpr("fn", "a AS n")
    got = {r.fn.split("::")[1]: r.complexity for r in flow.complexity(blocks, edges, extras).collect()}
    # pick: two ifs, a throw, && and one; fill: loop, two ifs, a condition and one; walk: while, do, three cases against default, &&, a catch and one
    assert got == {"<module>": 1, "lazy": 1, "pick": 5, "Box.constructor": 2, "Box.fill": 5, "twice": 1, "walk": 8}


def test_dead_code_and_reach(spark, found):
    blocks, edges, stmts = js.flow_tables(found.where("path = 'm.ts'"))
    dead = sorted((r.fn.split("::")[1], r.block, r.reason, r.severity) for r in flow.dead_code(blocks, edges, stmts, empty=False).collect())
    assert dead == [("pick", 8, "unreachable", "critical")]
    more = "function a() { while (1) { break; x() } return 1; }\nfunction b() { ; return; ; }\nfunction c() { try { throw e } catch { ok() } after() }\nfunction d(n) { switch (n) { case 1: return 1; default: return 2 } }"
    blocks, edges, stmts = js.flow_tables(js.facts(spark.createDataFrame([("x.js", more)], "path string, content string")))
    dead = sorted((r.fn.split("::")[1], r.reason) for r in flow.dead_code(blocks, edges, stmts, empty=False).collect())
    assert dead == [("a", "unreachable")]
    live = {(r.fn.split("::")[1], r.block) for r in flow.live_blocks(blocks, edges, stmts).collect()}
    assert ("c", 1) in live and ("d", 1) in live and ("d", 2) not in live  # both ways of d return, so what follows its switch is out of reach


def test_any_text_has_facts():
    rng = random.Random(0)
    words = "if ( ) { } else while for do switch case default : ; , => function class x y = + return break try catch finally import export from 'a' ` [ ] . ? && / \n new async * ${".split(" ")
    for _ in range(3000):
        rows = js.facts_of("x", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))))
        assert any(r[1] == "function" for r in rows)
