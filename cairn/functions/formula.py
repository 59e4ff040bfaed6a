"""Text functions over first-order formulas and premises."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.session import arrow_udf

_NAME = "[A-Za-z_][A-Za-z0-9_]*"
#: Words of the grammar that are no predicates or constants: fixed values.
RESERVED = ("ForAll", "Exists", "AND", "OR", "NOT", "implies", "IN", "In", "BICOND", "IMPLIES")
#: Words that predicate names lose when a set of formulas is unified: fixed values.
GENERIC = frozenset({
    "project", "projects", "python", "code", "standard", "standards", "rule", "rules", "requirement", "requirements", "practice", "practices",
    "convention", "conventions", "protocol", "protocols", "specification", "specifications", "constraint", "constraints", "condition", "conditions",
    "regulation", "regulations", "policy", "policies", "guideline", "guidelines", "recommendation", "recommendations", "system", "systems",
    "application", "applications", "program", "programs",
})
#: Symbols and their ASCII forms: fixed values.
SYMBOLS = {"→": "->", "∧": "AND", "∨": "OR", "¬": "NOT", "↔": "<->", "≥": ">=", "≤": "<=", "≠": "!=", "∈": "IN", "⊕": "OR", "&": "AND", "~": "NOT", "^": "AND"}
#: Markers that end a list of formulas in a model's reply: fixed values.
END_MARKERS = ("---", "Key Predicates", "Explanation:", "Predicate Key", "Key:", "Predicates:", "Notes:", "Key predicates:")
CANONICAL_VARIABLES = ("x", "y", "z", "w", "u", "v", "t", "s")


#: Titles that take up the names after them, and signs by what stands for them in a premise: fixed values.
TITLES = ("Dr", "Prof", "Mr", "Mrs", "Ms")
PREMISE_SIGNS = {"→": "->", "↔": "<->", "'": "", "’": "", "‘": ""}
_PIECE = re.compile(r"(?s)\d+(?:\.\d+)?|[^\W\d]\w*|\s+|.")


def _measured(number: str, after: list[str]) -> tuple[str, int] | None:
    """A time of day, temperature or duration that begins with this number as one word, and how many of the pieces after it belong to it."""
    used = 0
    minute = ""
    if after[:1] == [":"] and re.fullmatch(r"\d\d", "".join(after[1:2])):
        minute, used = after[1], 2
    used += "".join(after[used : used + 1]).isspace()
    unit = "".join(after[used : used + 1])
    if unit.upper() in ("AM", "PM") and len(number) <= 2:
        return f"Time{number}{minute}{unit.upper()}", used + 1
    if minute:
        return None
    if unit == "°" and after[used + 1 : used + 2] == ["C"]:
        return f"{number}C", used + 2
    return (f"Duration{number}Hours", used + 1) if unit in ("hour", "hours") else None


def _titled(after: list[str]) -> tuple[str, int]:
    """The capitalised words after a title put together, and how many pieces they are; no word in lower case, so that a sentence never
    becomes one name."""
    names, used = "", 0
    at = int(after[:1] == ["."])
    while at + 1 < len(after) and after[at].isspace() and "A" <= after[at + 1][0] <= "Z":
        names += after[at + 1]
        at += 2
        while after[at : at + 1] == ["-"]:
            more = 1 + (after[at + 1 : at + 2] != [] and after[at + 1][0].isalpha())
            names += "".join(after[at : at + more])
            at += more
        used = min(at, len(after))
    return names, used


@arrow_udf("string")
def normalize_premise(text: str | None) -> str:
    """A natural-language premise without tokens that a formula parser trips over, in one walk over its words, numbers and signs. Null
    gives an empty string."""
    pieces, out, k = _PIECE.findall(unicodedata.normalize("NFKC", text or "")), [], 0
    while k < len(pieces):
        piece, after, used = pieces[k], pieces[k + 1 : k + 40], 0
        if piece in TITLES and not (k and pieces[k - 1][-1].isalnum()):
            names, used = _titled(after)
            piece += names
        elif piece[0].isdecimal() and (found := _measured(piece, after)):
            piece, used = found
        out.append(PREMISE_SIGNS.get(piece, piece))
        k += 1 + used
    return " ".join("".join(out).split())


def repair_parentheses_plain(text: str) -> str:
    depth, out = 0, []
    for c in text:
        if c == ")" and depth == 0:
            continue
        depth += (c == "(") - (c == ")")
        out.append(c)
    return "".join(out) + ")" * depth


def repair_parentheses(column: Column) -> Column:
    """Unmatched closing parentheses removed from the left, missing ones appended."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        skip = (c == ")") & (a["depth"] == 0)
        move = F.when(c == "(", 1).when(c == ")", -1).otherwise(0)
        return F.struct(F.when(skip, 0).otherwise(a["depth"] + move).alias("depth"), F.when(skip, a["out"]).otherwise(F.concat(a["out"], c)).alias("out"))

    return F.aggregate(F.split(column, ""), start, step, lambda a: F.concat(a["out"], F.repeat(F.lit(")"), a["depth"])))


_THINK = re.compile(r"(?is)<\s*think\s*>.*?<\s*/\s*think\s*>")
_LEX = re.compile(
    r"(?P<quantifier>[∀∃]|�?\s*\b(?i:forall|exists)\b)|(?P<link>(?i:\b(?:and|or|not|implies)\b)|" + "|".join(map(re.escape, SYMBOLS)) + r"|<->|->)|(?P<compare>>=|<=|!=|=|<|>)"
    r"|(?P<number>\d+(?:\.\d+)?)|(?P<name>[A-Za-z_]\w*(?:-(?!>)\w+)*)|(?P<mark>[(),])|(?P<space>\s+)|(?P<other>.)"
)


def _lexed(text: str) -> list[tuple[str, str]]:
    """Kind and text of each token; symbols as their words, calls without inner parentheses as one token."""
    raw = [(m.lastgroup, m[0]) for m in _LEX.finditer(text)]
    out, k = [], 0
    while k < len(raw):
        kind, word = raw[k]
        at = k + 2 if k + 1 < len(raw) and raw[k + 1][0] == "space" else k + 1
        if kind == "name" and at < len(raw) and raw[at][1] == "(":
            end = next((i for i in range(at + 1, len(raw)) if raw[i][1] in "()"), len(raw))
            if end < len(raw) and raw[end][1] == ")" and end > at + 1:
                parts = "".join(x for _, x in raw[at + 1 : end]).split(",")
                out.append(("call", f"{word}({', '.join(_lowered(re.sub('[ .]', '_', x.strip())) for x in parts)})"))
                k = end + 1
                continue
        if kind == "quantifier":
            word = "ForAll" if word == "∀" or word[-6:].lower() == "forall" else "Exists"
        elif kind == "link":
            word = SYMBOLS.get(word, word.upper()).strip()
            kind, word = ("compare", word) if word in (">=", "<=", "!=") else ("link", "->" if word == "IMPLIES" else word)
        out.append((kind, word))
        k += 1
    return out


def _lowered(text: str) -> str:
    return re.sub(_NAME, lambda m: m[0] if m[0] in RESERVED else m[0].lower(), text)


def _opened(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Quantifiers in the form ForAll(x, whatever marks followed; a comparison that stands before its number and call, behind."""
    out: list[tuple[str, str]] = []
    k = 0
    while k < len(tokens):
        kind, word = tokens[k]
        ahead = [i for i in range(k + 1, min(len(tokens), k + 7)) if tokens[i][0] != "space"][:3]
        kinds, words = [tokens[i][0] for i in ahead], [tokens[i][1] for i in ahead]
        if kind == "quantifier":
            bracket = words[:1] == ["("] and kinds[1:2] == ["name"] and words[2:3] == [","]
            if bracket or kinds[:1] == ["name"]:
                name = words[1] if bracket else words[0]
                last = 2 if bracket else (1 if words[1:2] == [","] else 0)
                out += [("call", f"{word}("), ("name", _lowered(name)), ("mark", ",")]
                k = ahead[last] + 1
                continue
        if kind == "compare" and kinds[:2] == ["number", "call"]:
            out += [tokens[ahead[1]], (kind, word), tokens[ahead[0]]]
            k = ahead[1] + 1
            continue
        out.append((kind, word if kind != "name" or words[:1] == ["("] or word in RESERVED else word.lower()))
        k += 1
    return out


def normalize_formula_plain(text: str | None) -> str | None:
    if not text:
        return text
    out = ""
    for kind, word in _opened(_lexed(unicodedata.normalize("NFKC", _THINK.sub("", text).strip()))):
        if kind in ("link", "compare"):
            out = f"{out.rstrip()}{'' if out.rstrip().endswith('(') else ' '}{word} "
        elif kind == "space":
            out += "" if out[-1:] in ("(", " ", "") else " "
        elif word in (",", ")"):
            out = out.rstrip() + (", " if word == "," else ")")
        else:
            out += word
    return repair_parentheses_plain(out.strip()).strip()


@arrow_udf("string")
def normalize_formula(text: str | None) -> str | None:
    """A formula in the parser's notation: quantifiers, connectives, spacing, parentheses, lower-case terms."""
    return normalize_formula_plain(text)


def extract_formulas(column: Column) -> Column:
    """The formulas of a model's reply: the texts of a JSON list if it is one (in a code fence or bare), else its lines up to an
    end marker, without numbering and quotes; lines with a colon are headings. Null gives none."""
    text = F.trim(F.regexp_replace(F.coalesce(column, F.lit("")), _THINK.pattern, ""))
    listed = F.try_parse_json(F.regexp_extract(text, r"(?s)^(?:```(?:json)?\n)?(.*?)(?:\n```)?$", 1))
    items = F.filter(F.try_variant_get(listed, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    items = F.transform(items, lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    lines = F.transform(F.split(text, "\n"), F.trim)
    marker = "|".join(map(re.escape, END_MARKERS))
    last = F.aggregate(F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(marker)), i)), F.size(lines), lambda a, x: F.least(a, x))
    own = F.filter(F.slice(lines, F.lit(1), last), lambda x: ~F.contains(x, F.lit(":")))
    own = F.transform(own, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\d+[.)]\s*", ""), "^[\"']+|[\"']*,*$", ""))
    return F.coalesce(items, F.filter(own, lambda x: x != ""))


#: Where a name is cut: at underscores, before a capital after a small letter or digit, before the last capital of a run.
_SEAM = "_|(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z0-9])"


def split_name(column: Column) -> Column:
    """The words of a camelCase or snake_case name."""
    return F.split(column, _SEAM)


def split_name_plain(name: str) -> list[str]:
    return re.split(_SEAM, name)


def shorten_name_plain(name: str) -> str:
    while len(name) > 50:
        found = next((m for n in range(4, 40) if (m := re.search(rf"(?s)(.{{{n}}})\1+", name))), None)
        if not found:
            return name[:47] + "Trunc"
        name = name.replace(found[0], found[1])
    return name


@arrow_udf("string")
def shorten_name(name: str | None) -> str | None:
    """A name over 50 characters without its repetitions, else cut and marked."""
    return name and shorten_name_plain(name)


def _plain_name(name: str) -> str:
    """PascalCase of a name's words, without generic ones unless there are no others."""
    words = split_name_plain(name)
    told = [w for w in words if w.lower() not in GENERIC]
    return shorten_name_plain("".join(w[:1].upper() + w[1:] for w in told or words))


def unify_predicates_plain(formulas: list[str] | None) -> list[str] | None:
    """Every name that is called in one of the formulas, wherever it stands, by its plain name."""
    if not formulas:
        return formulas
    called = {m[1] for f in formulas for m in re.finditer(rf"({_NAME})\s*\(", f or "")}.difference(RESERVED[:7])
    return [f and re.sub(_NAME, lambda m: _plain_name(m[0]) if m[0] in called else m[0], f) for f in formulas]


@arrow_udf("array<string>")
def unify_predicates(formulas: list[str] | None) -> list[str] | None:
    """Predicate names of a set of formulas made alike: PascalCase without generic words."""
    return unify_predicates_plain(None if formulas is None else list(formulas))


def canonical_variables_plain(formula: str | None) -> str | None:
    if not formula:
        return formula
    bound = list(dict.fromkeys(re.findall(rf"\b(?:ForAll|Exists)\s*\(\s*({_NAME})\s*,", formula)))
    names = {v: CANONICAL_VARIABLES[k % len(CANONICAL_VARIABLES)] for k, v in enumerate(bound)}
    return re.sub(rf"\b{_NAME}\b", lambda m: names.get(m[0], m[0]), formula) if names else formula


def canonical_variables(column: Column) -> Column:
    """Bound variables renamed to x, y, z, w, u, v, t, s by first appearance (again from x after eight), all at once."""
    bound = F.array_distinct(F.regexp_extract_all(column, F.lit(rf"\b(?:ForAll|Exists)\s*\(\s*({_NAME})\s*,"), F.lit(1)))
    held = F.aggregate(F.transform(bound, lambda v, i: F.struct(v.alias("v"), i.alias("i"))), column, lambda f, x: F.regexp_replace(f, F.concat(F.lit(r"\b"), x["v"], F.lit(r"\b")), F.concat(F.lit("\x01"), x["i"] % 8, F.lit("\x01"))))
    for k, name in enumerate(CANONICAL_VARIABLES):
        held = F.replace(held, F.lit(f"\x01{k}\x01"), F.lit(name))
    return held


def structure_plain(formula: str | None) -> str:
    """The formula with each identifier that is no connective as VAR_i, numbered by first appearance."""
    names: dict[str, str] = {}
    keep = {*RESERVED, "TRUE", "FALSE", "True", "False"}
    return re.sub(rf"\b{_NAME}\b", lambda m: m[0] if m[0] in keep else names.setdefault(m[0], f"VAR_{len(names)}"), formula or "")


@arrow_udf("string")
def structure_key(formulas: list[str] | None) -> str:
    """Key of a sample's abstract structure: its formulas' structures, joined."""
    return "‖".join(structure_plain(f) for f in ([] if formulas is None else formulas))


def predicates(formulas: Column) -> Column:
    """Distinct predicate names of an array of formulas, sorted."""
    found = F.flatten(F.transform(formulas, lambda f: F.regexp_extract_all(f, F.lit(rf"\b({_NAME})\s*\("), F.lit(1))))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, RESERVED))))


def constants(formulas: Column) -> Column:
    """Distinct constants of an array of formulas, sorted: arguments of innermost predicates longer than one character
    that are neither bound variables nor reserved words."""
    inner = F.flatten(F.transform(formulas, lambda f: F.regexp_extract_all(f, F.lit(r"\b[A-Za-z_]\w*\s*\(([^()]*)\)"), F.lit(1))))
    args = F.flatten(F.transform(inner, lambda a: F.transform(F.split(a, ","), lambda x: F.trim(x))))
    bound = F.flatten(F.transform(formulas, lambda f: F.regexp_extract_all(f, F.lit(rf"\b(?:ForAll|Exists)\s*\(\s*({_NAME})"), F.lit(1))))
    named = F.filter(F.array_except(args, bound), lambda a: (F.length(a) > 1) & F.regexp_like(a, F.lit(rf"^{_NAME}$")))
    return F.array_sort(F.array_except(named, F.array(*map(F.lit, RESERVED))))


def unbracket_quantifiers(column: Column) -> Column:
    """ForAll([x], P) as ForAll(x, P), and ForAll([x, y], P) as nested quantifiers."""
    one = F.regexp_replace(column, rf"\b(ForAll|Exists)\s*\(\s*\[\s*({_NAME})\s*\]\s*,", "$1($2,")
    two = rf"\b(ForAll|Exists)\s*\(\s*\[\s*({_NAME})\s*,\s*({_NAME})\s*\]\s*,"
    return F.when(F.regexp_like(one, F.lit(two)), repair_parentheses(F.regexp_replace(one, two, "$1($2, $1($3,"))).otherwise(one)


def forbidden_symbols(formulas: Column) -> Column:
    """Positions (from 0) of formulas with / * [ or ]."""
    return F.filter(F.transform(formulas, lambda f, i: F.when(F.regexp_like(f, F.lit(r"[/*\[\]]")), i)), lambda i: i.isNotNull())


def looks_valid(column: Column) -> Column:
    """Balanced parentheses and no lower-case connectives or quantifiers."""
    balance = F.aggregate(F.filter(F.split(column, ""), lambda c: c.isin("(", ")")), F.lit(0), lambda n, c: F.when(n < 0, n).when(c == "(", n + 1).otherwise(n - 1))
    return (balance == 0) & ~F.regexp_like(column, F.lit(r"\b(?:and|or|not|implies|forall|exists|Forall)\b"))


def glossary(formulas: Column) -> Column:
    """struct predicates, constants of a sample's formulas."""
    return F.struct(predicates(formulas).alias("predicates"), constants(formulas).alias("constants"))


def glossary_text(formulas: Column) -> Column:
    return F.concat(F.lit("Predicates: "), F.array_join(predicates(formulas), ", "), F.lit("\nConstants: "), F.array_join(constants(formulas), ", "))
