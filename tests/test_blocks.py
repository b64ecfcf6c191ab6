"""Definition blocks of nine languages against hand-written ranges (start line, end line, kind)."""

import pytest
from pyspark.sql import functions as F

from strata.operators import blocks as B
from strata.operators import chunking as C

# fmt: off
CASES = [
("python","def f(\n    a,\n):\n    return eval(a)\n\nx = 1\n",[(1,4,"function_definition")]),
("python","import os\nif True:\n    def g():\n        return 1\ntry:\n    def h(): pass\nexcept E:\n    pass\n",[(3,4,"function_definition"),(6,6,"function_definition")]),
("python",'@dec\nclass A:\n    """doc\nclass not_code:\n    """\n    def m(self):\n        s = \'\'\'\nx = 1\n\'\'\'\n\n    async def n(self): ...\n# end\ny = lambda q: q\nz = sorted(\n    y,\n    key=lambda v: v,\n)\n',[(2,11,"class_definition"),(13,13,"lambda"),(14,17,"lambda")]),
("c","#include <a.h>\n#define X(a) \\\n  do { a; } while (0)\nint g(void) { return strcpy(a,b); }\nstruct s {\n  int a; /* } */\n};\nstatic int\nh(int a)\n{\n  char *p = \"}\";\n  if (a) { return 1; }\n  return '}';\n}\nint proto(int);\nint arr[] = {\n  1, 2\n};\ntypedef unsigned u;\nextern \"C\" {\nint k() {\n}\n}\n",
 [(2,3,"preproc_def"),(4,4,"function_definition"),(5,7,"struct_specifier"),(8,14,"function_definition"),(15,15,"declaration"),(16,18,"declaration"),(21,22,"function_definition")]),
("javascript","const t = `\n{ ${a}\n`;\nfunction f(u) {\n  return u;\n}\nclass K {\n  m() { return 1 }\n}\nmodule.exports = function () {\n  go();\n};\napp.get('/', (req, res) => {\n  res.send('}');\n});\nif (x) {\n  function inner() {\n  }\n}\nlet r = /[{]/.test(s)\nexport default async function z()\n{\n}\nfoo();\nvar v = 1\n",
 [(1,3,"lexical_declaration"),(4,6,"function"),(7,9,"class_declaration"),(10,12,"function_expression"),(13,15,"arrow_function"),(17,18,"function"),(20,20,"lexical_declaration"),(21,23,"function"),(25,25,"variable_declarator")]),
("java","package a;\nimport b.C;\n\n@Service\npublic class A {\n  int x = 1;\n  void m() { }\n}\ninterface I {\n  void q();\n}\nenum E {\n  P, Q;\n  int f() {\n    return 1;\n  }\n}\n",[(4,8,"class_declaration"),(9,11,"interface_declaration"),(14,16,"method_declaration")]),
("go","package main\n\nimport (\n  \"fmt\"\n)\n\ntype T struct {\n  a int\n}\n\nfunc (t T) M() int {\n  return 1 // }\n}\nfunc main() {\n  s := `}\n{`\n}\nvar f = func(a int) {\n}\ntype U int\n",[(7,9,"type_declaration"),(11,13,"method_declaration"),(14,17,"function_declaration"),(18,19,"function_literal"),(20,20,"type_declaration")]),
("rust","use std::io;\n#[derive(Debug)]\npub struct P<'a> {\n  x: &'a str,\n}\nimpl<'a> P<'a> {\n  fn f(&self) -> char { '}' }\n}\npub(crate) fn g() -> i32 {\n  let s = r#\"}\"#;\n  1\n}\nconst N: i32 = 1;\nmacro_rules! m {\n  () => {};\n}\nstatic S: i32 = 2;\n",[(1,1,"use_declaration"),(3,5,"struct_item"),(6,8,"impl_item"),(9,12,"function_item"),(13,13,"const_item"),(14,16,"macro_definition")]),
("php","<?php\nnamespace A;\nfunction f($a) {\n  // }\n  echo <<<EOT\n}\nEOT;\n  return 1;\n}\nabstract class B {\n  public function m() {}\n}\ntrait T {\n  private static function n()\n  {\n    # }\n  }\n}\n",[(3,9,"function_definition"),(10,12,"class_declaration"),(14,17,"method_declaration")]),
("ruby","module M\n  class A\n    def x\n      1\n    end\n\n    def y; 2; end\n  end\n\n  def self.z(a)\n    if a\n      a.each do |q|\n        puts \"end\"\n      end\n    end\n  end\nend\ndef k = 5\n=begin\ndef no\nend\n=end\ndef w\n  x = <<~EOS\n    end\n  EOS\nend\n",[(2,8,"class"),(10,16,"method"),(18,18,"method"),(23,27,"method")]),
("cpp","#include <v>\n#if A\nint a;\n#if B\n#endif\n#endif\nnamespace n {\nclass C { };\n}\ntemplate <class T>\nT max(T a, T b) {\n  return a;\n}\nint C::f() const {\n  auto s = R\"(}{)\";\n  int m = 1'000;\n  return 1;\n}\nusing x = int;\n",[(1,1,"preproc_include"),(2,6,"preproc_if"),(7,9,"namespace_definition"),(10,13,"template_declaration"),(14,18,"function_definition")]),
("kotlin","fun main() {\n}\n",[]),
("python","",[]),("c",None,[]),
]
# fmt: on


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(CASES)], "id int, lang string, text string")


def test_blocks_have_the_ranges_written_by_hand(files):
    for r in B.with_blocks(files, "text", "lang").collect():
        lang, text, want = CASES[r.id]
        assert [(c.start_line, c.end_line, c.kind) for c in r.chunks or []] == want, (r.id, lang)
        for c in r.chunks or []:
            assert c.text == "\n".join(text.split("\n")[c.start_line - 1:c.end_line])


def test_masking_keeps_line_numbers(files):
    for r in files.withColumn("m", B.masked_lines(F.col("lang"), F.col("text"))).where("text is not null").collect():
        assert len(r.m) == r.text.count("\n") + 1


def test_no_line_leaves_its_row(files):
    plan = B.block_chunks(files, ["id"], "text", "lang")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Window" not in plan


def test_files_without_blocks_fall_back(files):
    rows = B.block_chunks(files, ["id"], "text", "lang").collect()
    assert {(r.start_line, r.end_line, r.kind) for r in rows if CASES[r.id][0] == "kotlin"} == {(1, 2, None)}
    assert not [r for r in rows if not CASES[r.id][1]]


def test_very_long_strings_and_lines(spark):
    text = 's = """' + "x\\y\n" * 20_000 + '"""\ndef f():\n    return "' + "\\n" * 50_000 + '"\n'
    frame = spark.createDataFrame([(1, "python", text), (2, "javascript", "let a = `" + "\\`{" * 30_000 + "`;\n" + "/* " + "*" * 50_000)], "id int, lang string, text string")
    got = {r.id: [(c.start_line, c.end_line, c.kind) for c in r.chunks] for r in B.with_blocks(frame, "text", "lang").collect()}
    assert got == {1: [(20_002, 20_003, "function_definition")], 2: [(1, 1, "lexical_declaration")]}


def test_every_method_is_a_piece_and_fallback_chunks_stay(spark):
    code = "class A:\n    def a(self):\n        x = 1\n        return x\n\n    def b(self): pass\n\n    async def c(self):\n        if self:\n            return 1\n        return 2\n"
    frame = spark.createDataFrame([(1, "python", code), (2, "kotlin", "val a = 1\n"), (3, "javascript", "const k = 1;\nconst long = [\n  1,\n  2,\n];\n")],
                                  "id int, lang string, text string")
    pieces = B.pieces(B.block_chunks(frame, ["id"], "text", "lang"), ["id"])
    got = {(r.id, r.start_line, r.end_line, r.kind) for r in pieces.collect()}
    assert got == {(1, 1, 11, "class_definition"), (1, 2, 4, "function_definition"), (1, 6, 6, "function_definition"), (1, 8, 11, "function_definition"),
                   (2, 1, 1, None), (3, 1, 1, "lexical_declaration"), (3, 1, 1, "variable_declarator"), (3, 2, 5, "lexical_declaration"), (3, 2, 5, "variable_declarator")}
    kept = {(r.id, r.start_line, r.kind) for r in C.drop_trivial(pieces).collect()}
    assert kept == {(i, s, k) for i, s, _, k in got if (i, s, k) not in {(1, 6, "function_definition"), (3, 1, "variable_declarator")}}
