"""Column functions that parse and format the texts of design artifacts.

Everything here is an expression of built-in functions, so it stays inside the
engine's generated code.  A null input gives null unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cells that hold a bit over a clock edge
FLIP_FLOPS = ("$dff", "$dffe", "$adff", "$adffe", "$sdff", "$sdffe", "$sdffce", "$dffsr", "$dffsre", "$dlatch", "$adlatch", "$_DFF_", "$_DFFE_", "$_SDFF_", "$_DLATCH_")
FLIP_FLOP_PATTERN = r"(?i)^\$_?(a?d?s?d?ff|dlatch|adlatch)"
# Classes of commits, the first that matches the lower-cased message
COMMIT_CLASSES = (
    ("fix", r"\bfix(?:es|ed)?\b|\bbug\b|\bpatch\b|\bhotfix\b"),
    ("feature", r"\bfeat(?:ure)?\b|\badd(?:ed|s)?\b|\bnew\b|\bimplement"),
    ("refactor", r"\brefactor\b|\bclean\b|\brestructur"),
    ("test", r"\btest\b|\bverif"),
    ("docs", r"\bdoc\b|\bcomment\b|\breadme\b"),
    ("constraint", r"\bconstraint\b|\bsdc\b|\btiming\b"),
    ("synthesis", r"\bsynth\b|\bsynthes"),
    ("revert", r"\brevert\b"),
    ("merge", r"\bmerge\b"),
)
RTL_EXTENSIONS = ("v", "sv", "vh", "svh", "vhd", "vhdl")
ENTITY_STOP = ("the", "and", "for", "are", "has", "with", "that", "this", "from", "not", "have", "module", "modules")


def is_flip_flop(cell: Column) -> Column:
    """Whether a cell type is a flip-flop or a latch."""
    return cell.isin(*FLIP_FLOPS) | cell.rlike(FLIP_FLOP_PATTERN)


def binary_value(text: Column) -> Column:
    """A string of binary digits as a number, 0 for anything else (x and z bits, null)."""
    return F.coalesce(F.when(text.rlike("^[01]{1,63}$"), F.conv(text, 2, 10).cast("bigint")), F.lit(0).cast("bigint"))


def source_place(src: Column) -> Column:
    """``file:line.column-line.column``, ``file:line`` or ``file`` as struct(file, first_line, last_line)."""
    file = F.regexp_extract(src, r"^(.*?)(?::\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?)?$", 1)
    first = F.regexp_extract(src, r":(\d+)(?:\.\d+)?(?:-\d+(?:\.\d+)?)?$", 1).try_cast("int")
    last = F.regexp_extract(src, r"-(\d+)(?:\.\d+)?$", 1).try_cast("int")
    return F.struct(file.alias("file"), first.alias("first_line"), F.coalesce(last, first).alias("last_line"))


def design_name(hdlname: Column, key: Column) -> Column:
    """A module's written name: its attribute, else its key without the elaboration prefix."""
    tail = F.element_at(F.split(key, r"\\"), -1)
    return F.coalesce(F.when(hdlname != "", hdlname), F.when(key.startswith("$paramod"), tail).otherwise(F.ltrim(key, F.lit("\\"))))


def looks_like_clock(name: Column) -> Column:
    """Whether a port's name is that of a clock."""
    return F.lower(name).rlike("clk|clock|ck")


def reset_kind(parameters: Column) -> Column:
    """struct(kind, active_low) of a cell's reset by the presence of its polarity parameter."""
    asynchronous, synchronous = F.map_contains_key(parameters, "ARST_POLARITY"), F.map_contains_key(parameters, "SRST_POLARITY")
    polarity = F.coalesce(parameters["ARST_POLARITY"], parameters["SRST_POLARITY"])
    return F.struct(F.when(asynchronous, "async").when(synchronous, "sync").alias("kind"), (polarity == "0").alias("active_low"))


def clock_edge(parameters: Column) -> Column:
    """``posedge`` or ``negedge`` of a cell's clock."""
    return F.when(F.coalesce(parameters["CLK_POLARITY"], F.lit("1")).rlike("^0*1$"), "posedge").otherwise("negedge")


def get_targets(line: Column) -> Column:
    """Names inside the ``[get_...]`` brackets of a command, braces off, split at spaces."""
    groups = F.regexp_extract_all(line, F.lit(r"\[get_\w+\s+(\{[^{}]*\}|(?:[^\[\]\s{}]|\[[^\[\]]*\])*)\s*\]"), 1)
    return F.filter(F.flatten(F.transform(groups, lambda g: F.split(F.translate(g, "{}", ""), r"\s+"))), lambda w: w != "")


def get_targets_short(line: Column) -> Column:
    """As ``get_targets``, but a name ends at the first closing bracket (a bus loses its index's end)."""
    groups = F.regexp_extract_all(line, F.lit(r"\[get_\w+\s+([^\]]+)\]"), 1)
    return F.filter(F.flatten(F.transform(groups, lambda g: F.split(F.trim(F.translate(g, "{}", "")), r"\s+"))), lambda w: w != "")


def get_kind(line: Column) -> Column:
    """``ports`` for ``[get_ports ...]``, null without brackets."""
    return F.nullif(F.regexp_extract(line, r"\[get_(\w+)", 1), F.lit(""))


def command(line: Column) -> Column:
    """The first word of a command line."""
    return F.regexp_extract(line, r"^\s*(\S+)", 1)


def flag(line: Column, name: str) -> Column:
    """The value after ``-name``, a bracketed one whole; null if the flag is absent."""
    return F.nullif(F.regexp_extract(line, rf"(?:^|\s)-{name}\s+(\[[^\]]*\]|\{{[^}}]*\}}|[^\s\[\]-][^\s]*|-\d[^\s]*)", 1), F.lit(""))


def has_flag(line: Column, name: str) -> Column:
    """Whether ``-name`` occurs."""
    return line.rlike(rf"(?:^|\s)-{name}(?:\s|$)")


def first_number(line: Column) -> Column:
    """The first numeric word of a command, values of flags included."""
    return F.get(F.filter(F.split(F.trim(line), r"\s+"), lambda w: w.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$")), F.lit(0)).try_cast("double")


def join_continuations(text: Column) -> Column:
    """A text whose lines that end with a backslash go on in the next."""
    return F.regexp_replace(text, r"\\\r?\n[ \t]*", " ")


def strip_comment(line: Column) -> Column:
    """A command line without what follows a number sign."""
    return F.trim(F.regexp_replace(line, r"(^|\s)#.*$", ""))


def shell_words(line: Column) -> Column:
    """The words of a command as a shell reads them; the plain words of a line whose quoting is broken.

    Single quotes keep everything, double quotes all but a backslash before a quote
    or a backslash, a backslash outside keeps the next character; a number sign
    outside quotes begins a comment.
    """
    single, double, plain = r"'[^']*'", r'"(?:[^"\\]|\\.)*"', r"(?:[^\s'\"\\]|\\.)"
    word = rf"(?:{single}|{double}|{plain})+"
    rest = F.regexp_replace(line, rf"^((?:{single}|{double}|\\.|[^'\"\\#])*)#.*$", "$1")
    well = rest.rlike(rf"^\s*(?:{word}(?:\s+|$))*$")

    def unquoted(w: Column) -> Column:
        pieces = F.regexp_extract_all(w, F.lit(rf"{single}|{double}|{plain}+"), 0)
        inner = lambda p: F.substring(p, F.lit(2), F.length(p) - 2)
        one = lambda p: F.when(p.startswith("'"), inner(p)).when(p.startswith('"'), F.regexp_replace(inner(p), r'\\(["\\])', "$1")).otherwise(F.regexp_replace(p, r"\\(.)", "$1"))
        return F.array_join(F.transform(pieces, one), "")

    shell = F.transform(F.regexp_extract_all(rest, F.lit(word), 0), unquoted)
    split = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    return F.when(line.isNotNull(), F.when(well, shell).otherwise(split))


def commit_class(message: Column) -> Column:
    """The class of a commit by its message, null if none fits."""
    low, out = F.lower(message), None
    for name, pattern in COMMIT_CLASSES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out


def glob_pattern(glob: str) -> str:
    """A shell pattern as an anchored regular expression."""
    out = ""
    for c in glob:
        out += ".*" if c == "*" else "." if c == "?" else "\\" + c if c in r"\.^$+{}()|[]" else c
    return f"^{out}$"


def keep_matching(files: Column, globs: list[str]) -> Column:
    """The elements of an array of paths that match any pattern."""
    patterns = "|".join(glob_pattern(g) for g in globs)
    return F.filter(files, lambda f: f.rlike(patterns))


def module_of_file(path: Column) -> Column:
    """A source file's stem, null for files that are no sources."""
    return F.nullif(F.regexp_extract(path, rf"([^/]+)\.(?:{'|'.join(RTL_EXTENSIONS)})$", 1), F.lit(""))


def relative_path(path: Column, root: str) -> Column:
    """A path below ``root`` without it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, F.lit(len(base) + 1), F.length(path))).otherwise(path)


def shorten(text: Column, most: int = 200) -> Column:
    """A text of at most ``most`` characters, three dots for the rest."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def format_like(number: Column, template: Column) -> Column:
    """A whole number with underscore groups if the template has underscores."""
    return F.when(template.contains("_"), F.translate(F.format_number(number, 0), ",", "_")).otherwise(number.cast("bigint").cast("string"))


def path_reason(path: Column, relations: Column) -> Column:
    """``a --rel--> b | b --rel--> c``; ``directly changed`` for a path of one node."""
    steps = F.transform(F.sequence(F.lit(1), F.size(relations)), lambda i: F.concat(F.element_at(path, i), F.lit(" --"), F.element_at(relations, i), F.lit("--> "), F.element_at(path, i + 1)))
    return F.when(F.size(relations) < 1, "directly changed").otherwise(F.array_join(steps, " | "))


def word_set(text: Column) -> Column:
    """The distinct lower-cased words (letters, digits, underscores) of a text; empty for null."""
    return F.coalesce(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), 0)), F.array().cast("array<string>"))


def key_entities(text: Column) -> Column:
    """Identifiers of at least three characters in a gold answer, stop words out, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]+"), 0)
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda w: (F.length(w) >= 3) & ~w.isin(*ENTITY_STOP))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """A text with the first occurrence of ``old`` replaced; null if it does not occur."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text))))


def node_text(type_: Column, name: Column, id_: Column, attrs: Column) -> Column:
    """A node as a line of text for embedding: type, name, id and what it has of eleven attributes."""
    keys = ("direction", "width", "clock_signal", "constraint_type", "assertion_type", "property_text", "summary", "message", "raw_line", "period", "file_path")
    extra = [F.when(attrs[k].isNotNull(), F.concat(F.lit(f"{k}: "), attrs[k])) for k in keys]
    return F.concat_ws(" ", F.concat(type_, F.lit(":")), name, F.concat(F.lit("id: "), id_), *extra)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; a small constant in the norm keeps zero vectors at 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / (norm(a) * norm(b) + F.lit(1e-8))
