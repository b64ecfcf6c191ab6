"""Definition blocks of source files, found inside the row.

One row is one file, and no line leaves it:

1. *Mask*: one regular expression per language cuts the text into strings,
   comments and the rest. Comments lose everything but their line feeds, a
   string becomes a mark; the lines after its first one get another mark, so
   they are known as continuations. Line numbers don't change.
2. *Features* of each masked line: bracket balance (block keywords in Ruby),
   indentation, how it ends, and the kind of definition that it could begin.
3. *Fold*: an ``aggregate`` over the code lines with a struct as state (depth,
   the open definition with its depth, the finished ones). A definition that
   begins while none is open is an outermost one, at whatever depth: functions
   under ``if`` or ``try``, in a namespace that isn't a kind, assigned
   functions and callbacks. Brace languages: it ends on the line that brings the
   depth back and ends a statement. Python: before the next logical line that is
   indented no further. Ruby: with its ``end``.
4. In C, C++ and Java a line may begin a declaration or a function; which one is
   decided from the whole masked statement.

Blocks are whole lines, so a function in the middle of a line gives that line.
Files without a block fall back to C2. A null text has no chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import DEFAULT_KINDS, KINDS_BY_LANG
from ..functions.lines import explode_rows, indent_of, lines_l2, py_strip
from .chunking import CHUNK_TYPE, explode_chunks, threshold_for, with_fallback_chunks

#: What stands for a string, and for the rest of it on each further line.
STRING, GOES_ON = "\u0001", "\u0002"

_LINE_COMMENT, _HASH_COMMENT, _BLOCK_COMMENT = r"//[^\n]*+", r"#[^\n]*+", r"/\*(?s:.*?)(?:\*/|\z)"
_DOUBLE, _SINGLE = r'"(?:[^"\\\n]|\\(?s:.))*+"?', r"'(?:[^'\\\n]|\\(?s:.))*+'?"
_DOUBLE_LINES, _SINGLE_LINES = r'"(?:[^"\\]|\\(?s:.))*+"?', r"'(?:[^'\\]|\\(?s:.))*+'?"
_BACKTICK_RAW, _TEMPLATE = r"`[^`]*+`?", r"`(?:[^`\\]|\\(?s:.))*+`?"
_TEXT_BLOCK = r'"""(?:[^"\\]|\\(?s:.)|"(?!""))*+(?:"""|\z)'
_TRIPLE = r"[rRbBuUfF]{0,2}(?:" + _TEXT_BLOCK + r"|'''(?:[^'\\]|\\(?s:.)|'(?!''))*+(?:'''|\z))"
# a slash after these begins a regular expression
_AFTER = r"(?<=[=(,:\[!&|?;])"
_JS_REGEX = _AFTER + r"[ ]?/(?![/*])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*+\])++/"

#: Per language the comments and the strings, in the order in which they are tried.
LEXICON = {
    "python": ([_HASH_COMMENT], [_TRIPLE, _DOUBLE, _SINGLE]),
    "ruby": ([r"(?m:^=begin(?s:.*?)(?:^=end|\z))", _HASH_COMMENT],
             [r"<<[~-]?(['\"]?)([A-Z_]\w*)\1(?s:.*?)\n[ \t]*\2\b", _DOUBLE_LINES, _SINGLE_LINES]),
    "php": ([_BLOCK_COMMENT, _LINE_COMMENT, r"#(?!\[)[^\n]*+"], [r"<<<[ \t]*(['\"]?)(\w+)\1(?s:.*?)\n[ \t]*\2\b", _DOUBLE_LINES, _SINGLE_LINES]),
    "javascript": ([_BLOCK_COMMENT, _LINE_COMMENT], [_TEMPLATE, _DOUBLE, _SINGLE, _JS_REGEX]),
    "java": ([_BLOCK_COMMENT, _LINE_COMMENT], [_TEXT_BLOCK, _DOUBLE, _SINGLE]),
    "go": ([_BLOCK_COMMENT, _LINE_COMMENT], [_BACKTICK_RAW, _DOUBLE, _SINGLE]),
    # a quote without a second one nearby is a lifetime
    "rust": ([_BLOCK_COMMENT, _LINE_COMMENT], [r'b?r(#*)"(?s:.*?)"\1', _DOUBLE_LINES, r"'(?:[^'\\\n]|\\[^'\n]+|\\')'"]),
    "cpp": ([_BLOCK_COMMENT, _LINE_COMMENT], [r'R"([^(\s]{0,16})\((?s:.*?)\)\1"', _DOUBLE, r"(?<![0-9A-Fa-f])" + _SINGLE]),
    "c": ([_BLOCK_COMMENT, _LINE_COMMENT], [_DOUBLE, _SINGLE]),
}
LEXICON["typescript"] = LEXICON["javascript"]
_OTHER = LEXICON["c"]

_JS_WORDS = r"(?!(?:if|for|while|switch|catch|function|return|with|do|else|try|finally|new|typeof|await)\b)"
_C_WORDS = r"(?!(?:if|else|for|while|do|switch|case|default|return|goto|break|continue|using|typedef\s+(?!.*\b(?:struct|enum)\b)|public|private|protected)\b|extern\s+\x01)"
_JAVA_WORDS = r"(?!(?:if|else|for|while|do|switch|case|default|return|break|continue|try|catch|finally|package|import|throw|enum|record|module)\b)"

#: (language, kind, what a stripped masked line begins with). The first one that fits is taken. ``item``: kind decided at the end.
BEGINS = [
    ("python", "function_definition", r"^(async\s+)?def\s"),
    ("python", "class_definition", r"^class\b"),
    ("python", "lambda", r"(^|[^\w.])lambda\b"),
    ("javascript", "class_declaration", r"^(export\s+)?(default\s+)?(abstract\s+)?class\b"),
    ("javascript", "function", r"^(export\s+)?(default\s+)?(async\s+)?function\b"),
    ("javascript", "lexical_declaration", r"^(export\s+)?(const|let)\s"),
    ("javascript", "variable_declarator", r"^(export\s+)?var\s"),
    ("javascript", "function_expression", r"(^|[^\w$.])function\b"),
    ("javascript", "arrow_function", r"=>"),
    ("javascript", "method_definition", r"^((async|static|get|set)\s+)*[*#]?" + _JS_WORDS + r"[\w$]+\s*\([^;]*\)\s*\{"),
    ("java", "class_declaration", r"^((public|private|protected|abstract|final|static|sealed|strictfp)\s+)*class\s"),
    ("java", "interface_declaration", r"^((public|private|protected|abstract|static|sealed)\s+)*interface\s"),
    ("java", "item", r"^(@(?!interface\b)\w|" + _JAVA_WORDS + r"(?!((public|private|protected|static|final)\s+)*(enum|record)\s)"
     r"((public|private|protected|static|final|abstract|synchronized|native|transient|volatile|default)\s+)*(<[^>]*>\s+)?"
     r"[A-Za-z_][\w.]*(\s*<[^;=()]*>)?(\s*\[\s*\])*\s+[A-Za-z_]\w*\s*([(=;,\[]|$))"),
    ("go", "method_declaration", r"^func\s*\("),
    ("go", "function_declaration", r"^func\s+\w"),
    ("go", "type_declaration", r"^type\b"),
    ("go", "function_literal", r"(^|[^\w.])func\s*\("),
    ("rust", "function_item", r"^(pub(\([^)]*\))?\s+)?(default\s+)?(const\s+)?(async\s+)?(unsafe\s+)?(extern\s+\x01?\s*)?fn\s"),
    ("rust", "struct_item", r"^(pub(\([^)]*\))?\s+)?struct\s"),
    ("rust", "enum_item", r"^(pub(\([^)]*\))?\s+)?enum\s"),
    ("rust", "trait_item", r"^(pub(\([^)]*\))?\s+)?(unsafe\s+)?trait\s"),
    ("rust", "impl_item", r"^(unsafe\s+)?impl\b"),
    ("rust", "mod_item", r"^(pub(\([^)]*\))?\s+)?mod\s"),
    ("rust", "macro_definition", r"^macro_rules!"),
    ("rust", "use_declaration", r"^(pub(\([^)]*\))?\s+)?use\s"),
    ("rust", "const_item", r"^(pub(\([^)]*\))?\s+)?const\s"),
    ("php", "class_declaration", r"^((abstract|final|readonly)\s+)*class\s"),
    ("php", "method_declaration", r"^((public|protected|private|static|abstract|final)\s+)+function\b"),
    ("php", "function_definition", r"^function\s+&?\s*\w"),
    ("ruby", "method", r"^(private\s+|public\s+|protected\s+)?def\s"),
    ("ruby", "class", r"^class\b"),
    ("c", "preproc_def", r"^#\s*define\b"),
    ("c", "struct_specifier", r"^(typedef\s+|static\s+|const\s+)*struct\b[^(;=]*(\{|$)"),
    ("c", "enum_specifier", r"^(typedef\s+|static\s+|const\s+)*enum\b[^(;=]*(\{|$)"),
    ("c", "item", r"^" + _C_WORDS + r"[A-Za-z_]"),
    ("cpp", "preproc_def", r"^#\s*define\b"),
    ("cpp", "preproc_include", r"^#\s*include\b"),
    ("cpp", "preproc_if", r"^#\s*if"),
    ("cpp", "template_declaration", r"^template\s*<"),
    ("cpp", "namespace_definition", r"^(inline\s+)?namespace\b"),
    ("cpp", "class_specifier", r"^class\b[^(;=]*(\{|$)"),
    ("cpp", "struct_specifier", r"^(typedef\s+|static\s+|const\s+)*struct\b[^(;=]*(\{|$)"),
    ("cpp", "enum_specifier", r"^(typedef\s+|static\s+|const\s+)*enum\b[^(;=]*(\{|$)"),
    ("cpp", "item", r"^" + _C_WORDS + r"[A-Za-z_~:]"),
]
#: Kinds that aren't over before a body has begun, though a line may end like a statement.
WITH_BODY = ["class_declaration", "function", "method_definition", "function_declaration", "method_declaration"]
#: Languages in which the end of a line may end a statement.
SOFT = ["javascript", "go", "ruby"]

_RUBY_OPENS = r"^(class|module|def|if|unless|case|while|until|for|begin)\b|(^|[^\w.])do(\s*\|[^|]*\|)?$|=\s*(if|unless|case|begin)\b"
_RUBY_CLOSES = r"^end\b"


def _case(lang: Column, by_lang: dict[str, Column], default: Column) -> Column:
    out = None
    for name, value in by_lang.items():
        out = F.when(lang == name, value) if out is None else out.when(lang == name, value)
    return out.otherwise(default)


def masked_lines(lang: Column, text: Column) -> Column:
    """The lines of the text without comments, and with a mark for each string."""
    def mask(comments, strings):
        rest = r"[^\"'`/#<=RrbBuUfF\[(,:!&|?;0-9A-Za-z]++|[0-9A-Za-z_]++|(?s:.)"
        tokens = F.regexp_extract_all(text, F.lit("|".join([*comments, *strings, rest])), F.lit(0))
        comment, string = (F.lit("^(?:" + "|".join(x).replace(_AFTER, "") + r")\z") for x in (comments, strings))

        def masked(t):
            marked = F.regexp_replace(F.regexp_replace(t, r"\A[^\n]+", STRING), r"\n[^\n]*", "\n" + GOES_ON)
            return (F.when(~t.rlike(r"[\"'`/#<=]"), t).when(F.regexp_like(t, comment), F.regexp_replace(t, r"[^\n]+", ""))
                    .when(F.regexp_like(t, string), marked).otherwise(t))
        return F.array_join(F.transform(tokens, masked), "")
    return F.split(_case(lang, {k: mask(*v) for k, v in LEXICON.items()}, mask(*_OTHER)), "\n", -1)


def _count(c: Column, chars: str) -> Column:
    return F.length(c) - F.length(F.translate(c, chars, ""))


def _features(lang: Column, masked: Column) -> Column:
    """Per line: number, stripped text, kind it may begin, change of depth, whether a body begins, how it ends, indentation."""
    begins = {}
    for name in {b[0] for b in BEGINS}:
        def of_line(c, name=name):
            out = F.lit(None).cast("string")
            for _, kind, rx in reversed([b for b in BEGINS if b[0] == name]):
                if kind == "item" or kind in KINDS_BY_LANG.get(name, DEFAULT_KINDS):
                    out = F.when(c.rlike(rx), F.lit(kind)).otherwise(out)
            return out
        begins[name] = of_line

    def line(m, i):
        c = F.btrim(m, F.lit(" \t\r\f" + GOES_ON))
        preproc = lang.isin("c", "cpp") & c.startswith("#")
        ruby = F.when(c.rlike(_RUBY_OPENS) & ~c.rlike(r"(^|[;\s])end$"), 1).otherwise(0) - F.when(c.rlike(_RUBY_CLOSES), 1).otherwise(0)
        ruby = F.when(c.rlike(r"^def\s+[\w.?!]+(\([^)]*\))?\s*=[^=~]"), 0).otherwise(ruby)
        depth = _count(c, "([{") - _count(c, ")]}")
        conditional = F.when(c.rlike(r"^#\s*if"), 1).when(c.rlike(r"^#\s*endif"), -1).otherwise(0)
        return F.struct(
            (i + 1).alias("i"), c.alias("c"), _case(lang, {k: f(c) for k, f in begins.items()}, F.lit(None).cast("string")).alias("kind"),
            F.when(lang == "ruby", ruby).when(preproc, 0).otherwise(depth).cast("int").alias("delta"),
            F.when(lang == "cpp", conditional).otherwise(0).cast("int").alias("cond"),
            (c.contains("{") | (lang == "ruby")).alias("body"),
            F.when(F.coalesce(F.get(masked, i + 1).startswith(GOES_ON), F.lit(False)) | c.endswith("\\"), 0).when(preproc | c.rlike(r"[;}]$"), 2)
            .when(c.rlike(r"[=,+\-*/&|?:(\[{.<>]$") & ~c.rlike(r"(\+\+|--)$"), 0).otherwise(1).alias("ends"),
            (F.length(m) - F.length(F.ltrim(m, F.lit(" \t\f")))).cast("int").alias("indent"), m.startswith(GOES_ON).alias("on"))
    return F.filter(F.transform(masked, line), lambda x: (x["c"] != "") | x["on"])


def _fold(lang: Column, lines: Column) -> Column:
    """array<struct<s, e, kind>> of the outermost definitions."""
    none = F.lit(0)
    init = F.struct(none.alias("depth"), none.alias("cond"), F.lit(False).alias("open"), none.alias("s"), none.alias("d"), none.alias("e"),
                    F.lit(None).cast("string").alias("kind"), F.lit(False).alias("body"), F.lit(False).alias("runs"),
                    none.alias("from"), none.alias("indent"),
                    F.array().cast("array<struct<s:int,e:int,kind:string>>").alias("out"))
    python, soft = lang == "python", lang.isin(*SOFT)

    def block(a, e):
        return F.array(F.struct(a["s"].cast("int").alias("s"), e.cast("int").alias("e"), a["kind"].alias("kind")))

    def step(a, x):
        # a logical line goes on: in a string, in brackets, or behind a backslash
        goes_on = x["on"] | a["runs"] | (python & (a["depth"] > 0))
        closed_before = python & a["open"] & ~goes_on & (x["indent"] <= a["d"])
        was_open = a["open"] & ~closed_before
        # a lambda in a call begins with the logical line that it stands in
        inside = goes_on & ~x["on"] & (x["kind"] == "lambda")
        begins = ~was_open & x["kind"].isNotNull() & (~goes_on | inside)
        begin, indent = (F.when(goes_on, a[c]).otherwise(x[v]) for c, v in (("from", "i"), ("indent", "indent")))
        is_open = was_open | begins
        kind = F.when(begins, x["kind"]).otherwise(a["kind"])
        s = F.when(begins, begin).otherwise(a["s"])
        macro = lang.isin("c", "cpp") & a["runs"]  # brackets of a directive that goes on don't count
        after, cond = a["depth"] + F.when(macro, 0).otherwise(x["delta"]), a["cond"] + x["cond"]
        region = kind == "preproc_if"
        d = F.when(begins, F.when(python, indent).when(region, a["cond"]).otherwise(a["depth"])).otherwise(a["d"])
        body = F.when(begins, x["body"]).otherwise(a["body"] | x["body"])
        over = F.when(region, cond <= d).when(kind.isin("preproc_def", "preproc_include"), x["ends"] > 0).otherwise(
            (after <= d) & ((x["ends"] == 2) | (soft & (x["ends"] == 1) & (body | ~kind.isin(*WITH_BODY)))))
        closes = is_open & ~python & over
        out = F.when(closed_before, F.concat(a["out"], block(a, a["e"]))).otherwise(a["out"])
        now = F.struct(s.alias("s"), kind.alias("kind"))
        return F.struct(
            after.alias("depth"), cond.alias("cond"), (is_open & ~closes).alias("open"), s.alias("s"), d.alias("d"),
            x["i"].alias("e"), kind.alias("kind"), body.alias("body"), x["c"].endswith("\\").alias("runs"),
            begin.cast("int").alias("from"), indent.cast("int").alias("indent"),
            F.when(closes, F.concat(out, block(now, x["i"]))).otherwise(out).alias("out"))

    return F.aggregate(lines, init, step, lambda a: F.when(a["open"], F.concat(a["out"], block(a, a["e"]))).otherwise(a["out"]))


def _decided(lang: Column, b: Column, masked: Column) -> Column:
    """The kind of a block; an item's from its whole statement."""
    whole = F.btrim(F.regexp_replace(F.array_join(F.slice(masked, b["s"], b["e"] - b["s"] + 1), " "), r"\s+", " "))
    java = lang == "java"
    function = whole.rlike(r"^[^{;=]*\([^{;]*\)[^{;=]*\{") | whole.rlike(r"operator\s*[^\w\s(]+\s*\([^{;]*\)[^{;]*\{")
    abstract = java & whole.rlike(r"^[^{;=]*\([^{;=]*\)[^{;=]*;$")
    of_item = (F.when(java & whole.rlike(r"^(@\w+(\.\w+)*(\([^)]*\))? )*((public|private|protected|abstract|final|static) )*class "), "class_declaration")
               .when(java & whole.rlike(r"^(@\w+(\.\w+)*(\([^)]*\))? )*((public|private|protected|abstract|static) )*interface "), "interface_declaration")
               .when(function | abstract, F.when(java, "method_declaration").otherwise("function_definition"))
               .when(whole.endswith(";") & ~whole.startswith("typedef "), F.when(java, "field_declaration").otherwise("declaration")))
    return F.when(b["kind"] == "item", of_item).otherwise(b["kind"])


def with_blocks(df: DataFrame, text: str, lang: str, out: str = "chunks") -> DataFrame:
    """``df`` with array<struct> (CHUNK_TYPE) of its outermost definitions; empty if there is none."""
    lang = F.coalesce(F.col(lang), F.lit(""))
    # every array is a column of its own, so it is computed once
    d = df.withColumn("_ms", masked_lines(lang, F.col(text)))
    d = d.withColumn("_found", _fold(lang, _features(lang, F.col("_ms")))).withColumn("_ls", lines_l2(text))
    d = d.withColumn("_found", F.filter(F.transform("_found", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), _decided(lang, b, F.col("_ms")).alias("kind"))),
                                        lambda b: b["kind"].isNotNull()))
    blocks = F.transform("_found", lambda b, k: F.struct(
        k.alias("chunk_no"), b["s"].alias("start_line"), b["e"].alias("end_line"), F.lit(None).cast("int").alias("start_ord"),
        F.lit(None).cast("int").alias("end_ord"), (b["e"] - b["s"] + 1).alias("n_lines"), b["kind"].alias("kind"),
        F.array_join(F.slice("_ls", b["s"], b["e"] - b["s"] + 1), "\n").alias("text")))
    return d.withColumn(out, blocks.cast(CHUNK_TYPE)).drop("_ms", "_found", "_ls")


def block_chunks(df: DataFrame, keys: list[str], text: str, lang: str) -> DataFrame:
    """The outermost definitions of each file, or its C2 chunks if it has none. Columns as ``explode_chunks``.
    No exchange: a file's lines never leave its row."""
    base = df.select(*keys, F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    d = with_blocks(base, "_text", "_lang", "_blocks")
    d = with_fallback_chunks(d.withColumn("_fbt", F.when(F.size("_blocks") <= 0, F.col("_text"))), "_fbt", threshold_for("_lang"), out="_fb")
    return explode_chunks(d.withColumn("chunks", F.when(F.size("_blocks") > 0, F.col("_blocks")).otherwise(F.col("_fb"))), keys)


PIECE = "struct<start_line:int,end_line:int,kind:string,parent_kind:string,text:string>"


def pieces(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The input of C1c: (keys, start_line, end_line, kind, parent_kind, text) of every chunk, and of what is nested in it: each method
    of a Python class, up to its own last line, and the declarator of a JavaScript declaration. Inside the row."""
    d = chunks.withColumn("_ls", lines_l2("text")).withColumn("_in", F.transform("_ls", lambda l: F.when(py_strip(l) != "", indent_of(l))))
    n = F.size("_ls")
    methods = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("_ls", i).rlike(r"^\s+(async\s+)?def\s"))

    def extent(i):
        own = F.element_at("_in", i)
        behind = F.filter(F.sequence(i, n), lambda j: F.element_at("_in", j).isNotNull())
        stop = F.filter(behind, lambda j: (j > i) & (F.element_at("_in", j) <= own))
        last = F.array_max(F.filter(behind, lambda j: j < F.coalesce(F.get(stop, F.lit(0)), n + 1)))
        return F.struct((F.col("start_line") + i - 1).alias("start_line"), (F.col("start_line") + last - 1).alias("end_line"), F.lit("function_definition").alias("kind"),
                        F.lit("class_definition").alias("parent_kind"), F.array_join(F.slice("_ls", i, last - i + 1), "\n").alias("text")).cast(PIECE)

    top = F.struct("start_line", "end_line", "kind", F.lit(None).cast("string").alias("parent_kind"), "text").cast(PIECE)
    declarator = F.struct("start_line", "end_line", F.lit("variable_declarator").alias("kind"), F.col("kind").alias("parent_kind"),
                          F.regexp_extract("text", r"^(const|let)\s+((?s:.*));\s*$", 2).alias("text")).cast(PIECE)
    none = F.array().cast(f"array<{PIECE}>")
    nested = (F.when(F.col("kind") == "class_definition", F.transform(methods, extent))
              .when(F.col("kind") == "lexical_declaration", F.array(declarator)).otherwise(none))
    return explode_rows(d.withColumn("_p", F.concat(F.array(top), nested)), keys, "_p", "p").select(*keys, "p.*")
