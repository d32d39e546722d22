"""Facts of Go sources, and packages and their graph."""

from quarrel.operators import graph, metrics
from quarrel.sources import go

MAIN = '''// Package main runs "it" {
package main

import (
	"fmt"
	str "strings" // names
	_ `example.org/app/side`
	"example.org/app/lib"
)

import "example.org/app/lib/deep"

type Shape interface { Area() float64 }
type (
	Box struct {
		W, H int
		name string
	}
	List[T any] []T
)
type small struct{}

func simple() int { return 1 }

func branches(a, b int) (out map[string]struct{}, err error) {
	if a > 0 && b > 0 { // if
		for i := range b {
			switch i { case 1: fmt.Println("case"); case 2, 3: return; default: }
		}
	} else if a < 0 || b < 0 {
		f := func() { if a == 0 { str.ToUpper(`if { for`) } }
		f()
	}
	return
}

func (b *Box) Area() float64 { b.count(); return float64(b.W * b.H) }
func (b *Box) count() { b.name = "}" }
func (Box) Static() {}
'''


def test_facts_of_a_file(spark):
    found = go.facts(spark.createDataFrame([("/r/app/main.go", MAIN), ("/r/app/none.go", "func x() {}"), ("/r/app/null.go", None)], "path string, content string")).cache()
    of = lambda kind: found.where(f"kind = '{kind}'").collect()
    assert [(r.name, r.detail, r.line) for r in of("import")] == [("", "fmt", 5), ("str", "strings", 6), ("_", "example.org/app/side", 7), ("", "example.org/app/lib", 8), ("", "example.org/app/lib/deep", 11)]
    assert {(r.name, r.detail) for r in of("type")} == {("Shape", "interface"), ("Box", "other"), ("List", "other"), ("small", "other")}
    assert {(r.name, r.a, r.b, r.owner) for r in of("function")} == {("simple", 1, 0, ""), ("branches", 9, 3, ""), ("Box.Area", 1, 0, "Box"), ("Box.count", 1, 0, "Box"), ("Box.Static", 1, 0, "Box")}
    assert {(r.detail, r.a) for r in of("decision")} == {("if", 3), ("for", 1), ("case", 2), ("and", 1), ("or", 1)}
    assert {(r.owner, r.name, r.detail) for r in of("member")} == {("Box.Area", "count", "call"), ("Box.Area", "W", "field"), ("Box.Area", "H", "field"), ("Box.count", "name", "field")}
    assert len(of("error")) == 2
    # Methods without a receiver name say nothing of cohesion; the others are linked by their calls and fields.
    access = found.where("kind = 'member'").selectExpr("'Box' AS class", "owner AS method", "CASE detail WHEN 'call' THEN concat('Box.', name) ELSE name END AS target")
    both = access.union(access.selectExpr("class", "method", "method"))
    assert [(r.methods, r.lcom4) for r in metrics.lcom4(both).collect()] == [(2, 1)]


def test_packages_and_their_graph(spark):
    rows = [("/r/app/go.mod", "// x\nmodule example.org/app // y\n\ngo 1.22\n"), ("/r/app/main.go", MAIN), ("/r/app/lib/a.go", "package lib\nimport \"example.org/app/lib/deep\"\ntype A interface{}\ntype B struct{}\n"), ("/r/app/lib/b.go", "package lib\nimport d \"example.org/app/lib/deep\"\nimport \"example.org/app/lib\"\n"), ("/r/app/lib/b_test.go", "package lib\nimport \"example.org/app\"\n"), ("/r/app/lib/deep/go.mod", "module \"example.org/other\""), ("/r/app/lib/deep/c.go", "package deep\n"), ("/r/app/vendor/v.go", "package v\n"), ("/r/out.go", "package out\n")]
    files = spark.createDataFrame(rows, "path string, content string")
    modules = go.module_files(spark, files)
    assert sorted(tuple(r) for r in modules.collect()) == [("/r/app", "example.org/app"), ("/r/app/lib/deep", "example.org/other")]
    sources = files.where("path like '%.go'")
    places = go.packages(sources, modules)
    assert {r.path: r.package for r in places.collect()} == {"/r/app/main.go": "example.org/app", "/r/app/lib/a.go": "example.org/app/lib", "/r/app/lib/b.go": "example.org/app/lib", "/r/app/lib/b_test.go": "example.org/app/lib", "/r/app/lib/deep/c.go": "example.org/other"}
    one = modules.where("module = 'example.org/app'")
    nodes, edges = go.package_graph(go.facts(sources), go.packages(sources, one))
    assert sorted(tuple(r) for r in edges.select("src", "dst", "weight").collect()) == [("example.org/app", "example.org/app/lib", 1), ("example.org/app", "example.org/app/lib/deep", 1), ("example.org/app/lib", "example.org/app/lib/deep", 2)]
    assert {r.node: r.abstractness for r in nodes.collect()} == {"example.org/app": 0.333333, "example.org/app/lib": 0.5, "example.org/app/lib/deep": 0.0}
    assert {r.node for r in graph.node_flags(nodes.select("node"), edges).where("is_entry").collect()} == {"example.org/app"}
