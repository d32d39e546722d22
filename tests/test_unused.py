"""Resolution of imports and unused code over the facts of a small project."""

import pytest

from quarrel.operators import graph, unused
from quarrel.sources import js

FILES = {
    "/p/src/index.ts": "import { a, gone } from './lib'; import * as all from './whole'; import x, { y as z } from '../shared/util.js'; import { b } from '@/lib/deep'; a(); z(all.q, new Map(), new Own()); import('./lazy'); import p from 'react'; import q from '@scope/pkg/sub';",
    "/p/src/lib/index.ts": "export function a() {}\nexport function unusedFn() {}\nexport const value = 1;\nexport { re } from './deep';",
    "/p/src/lib/deep.ts": "export const b = 1, c = 2; export const re = 3;",
    "/p/src/whole.ts": "export const q = 1, r = 2;",
    "/p/shared/util.js": "export default 1; export function y() {}\nmodule.exports.old = 1;",
    "/p/src/lazy.js": "export const late = 1;",
    "/p/src/island.ts": "import './island2'; export const i = 1;",
    "/p/src/island2.ts": "import './island'; export const j = 1;",
    "/p/src/a.test.ts": "import { t } from './only-test'; t();",
    "/p/src/only-test.ts": "export const t = 1;",
    "/p/src/app/page.tsx": "export default function Page() {}\nexport const metadata = {}; export const other = 1;",
}


@pytest.fixture(scope="module")
def found(spark):
    return js.facts(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()


@pytest.fixture(scope="module")
def uses(found):
    return unused.resolved(found).cache()


def test_imports_are_resolved(uses):
    got = {(r.path[3:], r.target[3:], r.name) for r in uses.collect()}
    assert got == {("src/index.ts", "src/lib/index.ts", "a"), ("src/index.ts", "src/lib/index.ts", "gone"), ("src/index.ts", "src/whole.ts", "*"), ("src/index.ts", "shared/util.js", "default"), ("src/index.ts", "shared/util.js", "y"), ("src/index.ts", "src/lib/deep.ts", "b"), ("src/index.ts", "src/lazy.js", ""), ("src/lib/index.ts", "src/lib/deep.ts", "re"), ("src/island.ts", "src/island2.ts", ""), ("src/island2.ts", "src/island.ts", ""), ("src/a.test.ts", "src/only-test.ts", "t")}


def test_what_nobody_uses(found, uses):
    assert {(r.path[3:], r.name) for r in unused.unused_imports(found).collect()} == {("src/index.ts", n) for n in ("gone", "x", "b", "p", "q")}
    got = {(r.path[3:], r.name, r.severity) for r in unused.unused_exports(found, uses).collect()}
    assert got == {("src/lib/deep.ts", "c", "info"), ("shared/util.js", "old", "info"), ("src/lazy.js", "late", "info"), ("src/island.ts", "i", "info"), ("src/island2.ts", "j", "info"), ("src/app/page.tsx", "other", "info")}
    assert {r.path[3:] for r in unused.orphans(found, uses).collect()} == {"src/island.ts", "src/island2.ts", "src/only-test.ts"}


def test_coupling_and_modules(found, uses):
    rows = {r["class"][3:]: r for r in unused.file_coupling(found).collect()}
    assert len(rows) == len(FILES) and rows["src/whole.ts"].cbo == 0 and rows["src/whole.ts"].risk == "low"
    assert "react" in rows["src/index.ts"].deps and "@scope/pkg" in rows["src/index.ts"].deps and "Own" in rows["src/index.ts"].deps and "Map" not in rows["src/index.ts"].deps
    nodes, edges = unused.module_tables(found, uses)
    assert {r.node for r in nodes.where("external").collect()} == {"react", "@scope/pkg"}
    got = {(r.src[3:], r.dst.removeprefix("/p/")): (r.kind, r.weight) for r in edges.collect()}
    assert got["src/index.ts", "src/lib/index.ts"] == ("import", 2) and got["src/index.ts", "src/lazy.js"] == ("dynamic", 1) and got["src/index.ts", "react"] == ("import", 1)
    assert graph.load_time(edges).count() == edges.count() - 1
    assert [r["size"] for r in graph.cycles(edges.select("src", "dst")).collect()] == [2]
