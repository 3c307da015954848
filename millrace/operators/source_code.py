"""Language of a code snippet, and its comments blanked out."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import rx

# Endings and names that tell a language.
ENDINGS = {
    "node": (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"), "python": (".py",), "php": (".php",), "java": (".java",),
    "ruby": (".rb",), "go": (".go",), "dotnet": (".cs",), "curl": (".sh", ".bash"),
}
HINTS = {
    "node": ("node", "nodejs", "js", "javascript", "ts", "typescript"), "python": ("python", "py"), "php": ("php",), "java": ("java",),
    "ruby": ("ruby", "rb"), "go": ("go", "golang"), "dotnet": ("dotnet", "csharp", "cs"), "curl": ("curl", "bash", "shell"),
}
# Signatures; (pattern, flags). <Brand> and <brand> are the vendor's name.
SIGNATURES = {
    "node": ((r"\brequire\s*\(", ""), (r"\bimport\s+[\s\S]*?from\s+[\"']", ""), (r"\bconst\s+\w+\s*=", ""), (r"\blet\s+\w+\s*=", ""), (r"\b(module\.exports|exports\.\w+)\b", ""), (r"\bnew\s+<Brand>\s*\(", ""), (r"=>", "")),
    "python": ((r"^\s*def\s+\w+\s*\(", "m"), (r"^\s*import\s+\w+", "m"), (r"^\s*from\s+\w+\s+import\b", "m"), (r"\b<brand>\.Client\s*\(", ""), (r":\s*$", "m")),
    "php": ((r"<\?php", ""), (r"\$\w+\s*=", ""), (r"->\w+\s*\(", ""), (r"\\<Brand>\\Api\\Api", ""), (r"\bjson_encode\s*\(", "")),
    "java": ((r"\bpublic\s+(class|static|void)\b", ""), (r"\bSystem\.out\.println\b", ""), (r"\bnew\s+<Brand>Client\s*\(", ""), (r"\bimport\s+com\.<brand>\b", "")),
    "ruby": ((r"^\s*def\s+\w+", "m"), (r"\brequire\s+[\"']<brand>[\"']", ""), (r"\b<Brand>\s*::\s*Client\b", ""), (r"\bend\s*$", "m"), (r":\w+\s*=>", "")),
    "go": ((r"\bpackage\s+\w+", ""), (r"^\s*import\s+[\"(]", "m"), (r"\bfunc\s+\w+", ""), (r"\b<brand>\.NewClient\b", ""), (r":=", "")),
    "dotnet": ((r"\busing\s+System;", ""), (r"\bnamespace\s+\w+", ""), (r"\bnew\s+<Brand>Client\s*\(", ""), (r"\bvar\s+\w+\s*=", "")),
    "curl": ((r"\bcurl\s+(-[A-Za-z]+\s+)*https?://", ""), (r"\bcurl\s+\\?\s*$", "m")),
}

#: What each of these signatures can't match without; a text without it isn't searched by the pattern.
NEEDS = {
    "node": ("require", "import", "const", "let", "exports", "<Brand>", "=>"),
    "python": ("def", "import", "from", "<brand>.Client", ":"),
    "php": ("<?php", "$", "->", "\\Api\\Api", "json_encode"),
    "java": ("public", "System.out.println", "<Brand>Client", "com.<brand>"),
    "ruby": ("def", "<brand>", "<Brand>", "end", "=>"),
    "go": ("package", "import", "func", "<brand>.NewClient", ":="),
    "dotnet": ("using", "namespace", "<Brand>Client", "var"),
    "curl": ("curl", "curl"),
}


def named(pattern: str, brand: str, key: str) -> str:
    """A pattern with the vendor's name and key prefix put in."""
    return pattern.replace("<Brand>", brand[:1].upper() + brand[1:]).replace("<brand>", brand.lower()).replace("<key>", key.lower()).replace("<KEY>", key.upper())


def language_of(code: Column, hint: Column | None = None, brand: str = "acme") -> Column:
    """A hint's language by its ending or name; else that with most signatures in the code, the first on ties, or unknown."""

    def shown(p: str, flags: str, needed: str) -> Column:
        there = F.contains(code, F.lit(named(needed, brand, brand))) & code.rlike(rx(named(p, brand, brand), flags))
        return F.coalesce(there, F.lit(False)).cast("int")

    def score(i: int, lang: str) -> Column:
        n = reduce(Column.__add__, [shown(p, f, x) for (p, f), x in zip(SIGNATURES[lang], NEEDS[lang], strict=True)])
        return F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(lang).alias("lang"))

    nothing = F.struct(F.lit(0).alias("n"), F.lit(1).alias("i"), F.lit("unknown").alias("lang"))  # before all others without a signature
    scored = F.array_max(F.array(nothing, *[score(i, lang) for i, lang in enumerate(SIGNATURES)]))["lang"]
    if hint is None:
        return scored
    low = F.lower(F.trim(hint))
    by_end = [F.when(reduce(Column.__or__, [low.endswith(e) for e in ends]), F.lit(lang)) for lang, ends in ENDINGS.items()]
    by_name = [F.when(low.isin(*names), F.lit(lang)) for lang, names in HINTS.items()]
    return F.coalesce(*by_end, *by_name, scored)


def _string(q: str) -> str:
    """A literal up to its end, or to the end of its line."""
    return rf"{q}[^{q}\\\n]*+(?:\\[\s\S][^{q}\\\n]*+)*+(?:\\\z)?{q}?"


_PLAIN = "|".join([_string('"'), _string("'")])
_C_LIKE = r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)"
_TRIPLE = '"""[\\s\\S]*?(?:"""|\\z)|' + "'''[\\s\\S]*?(?:'''|\\z)"
#: What is stepped over at once, a family of languages each, and which of it is a comment.
SPANS = {
    ("python",): (f"{_TRIPLE}|#[^\\n]*|{_PLAIN}", r"\A(?:#|\"\"\"|''')"),
    ("ruby", "curl"): (f"#[^\\n]*|{_PLAIN}", r"\A#"),
    ("node",): (f"{_C_LIKE}|{_PLAIN}|{_string('`')}", r"\A/"),
    ("java", "go", "dotnet", "kotlin"): (f"{_C_LIKE}|{_PLAIN}", r"\A/"),
    ("php",): (f"{_C_LIKE}|#[^\\n]*|{_PLAIN}", r"\A[/#]"),
}


_STARS = r"/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\z)"
_TRIPLES = "|".join(f"{q * 3}[^{q}]*+(?:{q}(?!{q * 2})[^{q}]*+)*+(?:{q * 3}|\\z)" for q in "\"'")
#: The same of each family for one pass over a text: how comments begin, whole comments, strings. Characters that begin neither are taken by the run.
PASSES = {
    ("python",): (("#", '"""', "'''"), rf"#[^\n]*+|{_TRIPLES}", _PLAIN),
    ("ruby", "curl"): (("#",), r"#[^\n]*+", _PLAIN),
    ("node",): (("//", "/*"), rf"//[^\n]*+|{_STARS}", f"{_PLAIN}|{_string('`')}"),
    ("java", "go", "dotnet", "kotlin"): (("//", "/*"), rf"//[^\n]*+|{_STARS}", _PLAIN),
    ("php",): (("//", "/*", "#"), rf"//[^\n]*+|#[^\n]*+|{_STARS}", _PLAIN),
}


def _blanked(code: Column, begins: tuple[str, ...], comments: str, strings: str) -> Column:
    """The text as comments and what is between them, found in one pass; a comment's lines become spaces of their length."""
    first = "".join(sorted({b[0] for b in begins} | set("\"'`" if "`" in strings else "\"'")))
    begin = "|".join(re.escape(b) for b in begins)
    parts = F.regexp_extract_all(code, F.lit(rf"(?:[^{first}]++|(?!{begin})(?:{strings}|[\s\S]))++|{comments}"), F.lit(0))
    is_comment = lambda x: reduce(Column.__or__, [F.startswith(x, F.lit(b)) for b in begins])
    spaces = lambda x: F.array_join(F.transform(F.split(x, "\n", -1), lambda line: F.repeat(F.lit(" "), F.length(line))), "\n")
    return F.array_join(F.transform(parts, lambda x: F.when(is_comment(x), spaces(x)).otherwise(x)), "")


def without_comments(code: Column, lang: Column) -> Column:
    """code with comments turned into spaces; line breaks, strings and the length stay. Other languages: as it is."""
    out = code
    for langs, (begins, comments, strings) in PASSES.items():
        some = reduce(Column.__or__, [F.contains(code, F.lit(b)) for b in begins])
        out = F.when(lang.isin(*langs), F.when(some, _blanked(code, begins, comments, strings)).otherwise(code)).otherwise(out)
    return out
