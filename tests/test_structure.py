import pytest
from pyspark.sql import functions as F

from sourcelake import schemas
from sourcelake.operators import structure


def extract(spark, path, text):
    df = spark.createDataFrame([("r", path, text, None)], schemas.FILES)
    return structure.extract_structure(df).collect()[0]


PY = '''"""Module.

import fake
def fake(): pass
"""
from __future__ import annotations
import os, sys
import a.b as c; import d  # trailing
from x import (  # why (not)
    one,
    two,
)
from . import sibling
from y import p, \\
    q
# import commented
# it's """ not a string
try: import fast
except ImportError: fast = None
text = "import quoted # no"
other = 'def no(): """'

@decorated
class Outer(Base):
    \'\'\'class Hidden: \'\'\'
    class Inner: pass
    def method(self): return {"def": 1}
    async def later(self):
        def nested(): pass
        import local
        return r"\\"
def größe(): yield
class_ = define = 1
'''


def test_python(spark):
    r = extract(spark, "m.py", PY)
    assert r.language == "python"
    assert r.functions == ["method", "later", "nested", "größe"]
    assert r.classes == ["Outer", "Inner"]
    assert r.imports == [
        "import os, sys", "import a.b as c", "import d", "from x import (  # why (not)\n    one,\n    two,\n)",
        "from . import sibling", "from y import p, \\\n    q", "import fast", "import local",
    ]
    assert r.exports is None and r.interfaces is None and r.types is None and r.enums is None
    assert r.n_chars == len(PY)


TS = '''/* import no from "./no"; */
import React, { type FC } from "react"; // import x from "y";
import {
  a, // first
  b,
} from './ab'
import "./side.css";
import type { T } from "./types";
import fs = require("fs");
const lazy = import("./lazy");
const url = "http://x"; // function no() {}
const t = `import z from "z";`;
const re = /["'`]/;
export { a, b } from "./again";
export * from "./all";
export default function main<T extends { x: number }>(p: T): string { if (p) { return "}"; } return `}`; }
export function over(a: string): string;
export function over(a: any): any { return a; }
export const arrow = (x: number) => {
  return x;
};
export interface Shape { kind: "circle" | "square" }
export type Union =
  | "a"
  | "b";
export const enum Color { Red, Green }
export abstract class Base { abstract f(): void; }
@Injectable() export class Service { run() { function inner() {} } }
declare class Ambient {}
async function later() {}
function* gen() {}
const Expr = class Named {};
const fn = function notDeclared() {};
'''


def test_typescript(spark):
    r = extract(spark, "m.ts", TS)
    assert r.language == "typescript"
    assert r.imports == [
        'import React, { type FC } from "react";', "import {\n  a, // first\n  b,\n} from './ab'", 'import "./side.css";',
        'import type { T } from "./types";', 'import fs = require("fs");',
    ]
    assert r.functions == ["main", "over", "inner", "later", "gen"]
    assert r.classes == ["Service", "Ambient"]
    assert (r.interfaces, r.types, r.enums) == (["Shape"], ["Union"], ["Color"])
    assert r.exports == [
        'export { a, b } from "./again";',
        'export * from "./all";',
        'export default function main<T extends { x: number }>(p: T): string { if (p) { return "}"; } return `}`; }',
        "export function over(a: string): string;",
        "export function over(a: any): any { return a; }",
        "export const arrow = (x: number) => {",
        'export interface Shape { kind: "circle" | "square" }',
        "export type Union =",
        "export const enum Color { Red, Green }",
        "export abstract class Base { abstract f(): void; }",
    ]


def test_javascript_requires(spark):
    text = '"use strict"; const a = require("./a"), b = require( \'b\' );\n// require("no")\nfoo(require("./c")());\nimport x from "./d"\n'
    r = extract(spark, "m.js", text)
    assert r.imports == ["require:./a", "require:b", "require:./c", 'import x from "./d"']
    assert r.interfaces == [] and r.exports == []


@pytest.mark.parametrize("path,language", [
    ("a.py", "python"), ("a.JSX", "javascript"), ("d/a.ts", "typescript"), ("a.tsx", "tsx"), ("a.rb", "unknown"),
    ("d.py/a", "unknown"), (".py", "unknown"), ("d/..py", "unknown"), (".a.py", "python"), ("a.d.ts", "typescript"),
])
def test_language(spark, path, language):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(structure.detect_language(F.col("path"))).first()[0] == language


def test_unreadable_files_are_set_aside(spark):
    df = spark.createDataFrame([("r", "a.py", "x", None), ("r", "b.rb", "x", None), ("r", "c.py", None, None)], schemas.FILES)
    good, bad = structure.split_languages(df)
    assert [r.path for r in good.collect()] == ["a.py"]
    assert sorted(r.path for r in bad.collect()) == ["b.rb", "c.py"]


def test_large_and_unterminated_text(spark):
    """No pattern may run out of stack or time on long input."""
    long = "x = '" + "a" * 500_000 + "'\nimport os\n" + '"""' + "open " * 100_000
    assert extract(spark, "m.py", long).imports == ["import os"]
    long = "/*" + "*" * 300_000 + "*/\nimport x from 'y';\nconst s = `" + "a`+`" * 50_000 + "`;\nexport const o = " + "{" * 200 + "}" * 200
    assert extract(spark, "m.ts", long).imports == ["import x from 'y';"]


def test_symbols_long_form(spark, rows):
    df = spark.createDataFrame([("r", "m.py", "import a\nimport b\nclass C: pass\n", None)], schemas.FILES)
    long = structure.symbols(structure.extract_structure(df))
    assert rows(long) == [
        ("r", "m.py", "classes", 0, "C"), ("r", "m.py", "imports", 0, "import a"), ("r", "m.py", "imports", 1, "import b"),
    ]


def test_no_depth_is_too_deep(spark):
    deep = "[" * 60 + "]" * 60
    code = (
        f"export const a = {deep};\n" + " " * 70 + "export const b = 1;\nexport {\n  c,\n  d,\n} from './x';\n"
        f"function far(p = {'(' * 12}1{')' * 12}) {{\n  return p;\n}}\nexport * as ns from \"./y\";\n// export const no = 1;\n"
    )
    r = structure.extract_structure(spark.createDataFrame([("r", "a.ts", code, None)], schemas.FILES)).first()
    assert r.exports == [f"export const a = {deep};", "export const b = 1;", "export {\n  c,\n  d,\n} from './x';", 'export * as ns from "./y";']
    assert r.functions == ["far"]
