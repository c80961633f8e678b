"""Secret scans with DataFrame functions only: fixed patterns, and entropy of sliding windows over candidate strings.

A candidate is a run of at least WINDOW characters of the token alphabet.  Its class (hexadecimal or mixed) sets the
alphabet and the threshold.  A window of WINDOW characters slides over it; one count for each character of the alphabet
is raised for the character that comes in and lowered for the one that goes out, and with them the sum of
count * log2(count), from which the entropy follows at once.  Windows at or above the threshold are joined to spans.
Candidates that the allow-list knows (UUIDs, words and file or host names, placeholders, plain numbers) are left out,
as are spans inside a base span.  Places are code points: the matches and the gaps that split() leaves between them
add up to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: The base patterns, fixed values.  Runs under the least length are dropped: from a place where a longer run of the same
#: characters starts no later place does better, so access and hex can ask for the length at once; assign cannot.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Alphabets of the classes (upper-case hexadecimal digits count as lower-case ones) and entropy thresholds in bits.
CLASSES = {"hex": ("0123456789abcdef", 3.0), "mixed": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.75)}
ALLOW = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)example|sample|placeholder|change_?me|dummy|redacted",
    r"(?i)0123456789|abcdefghij|(.)\1{5}",
    r"^[0-9+/_=-]*$",
    r"^[+/_=-]*([A-Za-z]+|[0-9]{1,4})([+/_=-]+([A-Za-z]+|[0-9]{1,4}))*[+/_=-]*$",
    r"^[A-Za-z]{12,}[0-9]{0,4}$",
)


def _places(name: str, keep: str = "") -> str:
    """SQL: array of (s, e, m), the places of the matches m that keep (a condition on x.m) holds."""
    m, g = f"_s_m_{name}", f"_s_g_{name}"
    start = f"acc.at + char_length({g}[i - 1])"
    all_ = f"""aggregate(sequence(1, size({m})), named_struct('at', 0, 'out', cast(array() as array<struct<s:int,e:int,m:string>>)),
      (acc, i) -> named_struct('at', {start} + char_length({m}[i - 1]),
        'out', concat(acc.out, array(named_struct('s', {start}, 'e', {start} + char_length({m}[i - 1]), 'm', {m}[i - 1])))),
      acc -> acc.out)"""
    return f"if(size({m}) = 0, cast(array() as array<struct<s:int,e:int,m:string>>), " + (f"filter({all_}, x -> {keep})" if keep else all_) + ")"


def _windows() -> str:
    """SQL: spans (s, e) inside the candidate c.m whose windows reach the threshold."""
    hex_, mixed = CLASSES["hex"], CLASSES["mixed"]
    sort = "c.m rlike '^([0-9a-f]+|[0-9A-F]+)$'"
    text = f"if({sort}, lower(c.m), c.m)"
    alphabet, bound, size = f"if({sort}, '{hex_[0]}', '{mixed[0]}')", f"if({sort}, {hex_[1]}D, {mixed[1]}D)", f"if({sort}, {len(hex_[0])}, {len(mixed[0])})"
    log = "if({0} < 2, 0D, {0} * log2({0}))"
    # One step: the character at place i comes in, the one at i - WINDOW goes out.
    step = f"""(acc, i) -> transform(array(named_struct('in', instr(w.alphabet, substr(w.text, i, 1)), 'out', if(i > {WINDOW}, instr(w.alphabet, substr(w.text, i - {WINDOW}, 1)), 0))), ch ->
      transform(array(named_struct('ci', element_at(acc.counts, ch.in), 'co', if(ch.out = 0 or ch.out = ch.in, 0, element_at(acc.counts, ch.out)), 'same', ch.out = ch.in)), k ->
        transform(array(if(k.same, acc.sum, acc.sum - {log.format("k.ci")} + {log.format("(k.ci + 1)")} - if(k.co = 0, 0D, {log.format("k.co")} - {log.format("(k.co - 1)")}))), sum ->
          named_struct('counts', if(k.same, acc.counts, transform(acc.counts, (n, j) -> n + if(j + 1 = ch.in, 1, 0) - if(j + 1 = ch.out, 1, 0))),
            'sum', sum,
            'out', if(i < {WINDOW} or log2({WINDOW}D) - sum / {WINDOW} < w.bound, acc.out,
              if(size(acc.out) > 0 and element_at(acc.out, -1).e >= i - {WINDOW},
                concat(slice(acc.out, 1, size(acc.out) - 1), array(named_struct('s', element_at(acc.out, -1).s, 'e', i))),
                concat(acc.out, array(named_struct('s', i - {WINDOW}, 'e', i))))))
        )[0])[0])[0]"""
    start = "named_struct('counts', array_repeat(0, w.size), 'sum', 0D, 'out', cast(array() as array<struct<s:int,e:int>>))"
    return f"""flatten(transform(array(named_struct('text', {text}, 'alphabet', {alphabet}, 'bound', {bound}, 'size', {size})), w ->
      aggregate(sequence(1, char_length(w.text)), {start}, {step}, acc -> acc.out)))"""


def scan(docs: DataFrame, text: Column | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """docs with one more column _spans: array of (s, k, e), the spans' start, kind (index in KINDS) and end, sorted.

    Matches of each base kind are leftmost and do not overlap; assign needs 8 characters in its value, access 16 and hex
    32 in all.  Null and empty texts have no spans; there is no limit on a text's length or number of spans.  The
    names of other columns do not matter, except for names that begin with _s_.
    """
    df = docs.withColumn("_s_text", F.coalesce(F.col("text") if text is None else text, F.lit("")))
    base = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    for name, pattern in [*base.items(), ("entropy", CANDIDATE)]:
        df = df.withColumn(f"_s_m_{name}", F.regexp_extract_all("_s_text", F.lit(pattern), F.lit(0)))
    for name, pattern in [*base.items(), ("entropy", CANDIDATE)]:
        df = df.withColumn(f"_s_g_{name}", F.when(F.size(f"_s_m_{name}") > 0, F.split("_s_text", pattern, -1)).otherwise(F.array(F.lit(""))))
    quoted = ASSIGN.replace("\\", "\\\\").replace("'", "\\'")
    for name in base:
        df = df.withColumn(f"_s_{name}", F.expr(_places(name, f"char_length(regexp_extract(x.m, '{quoted}', 2)) >= 8" if name == "assign" else "")))
    strings = [a.replace("\\", "\\\\").replace("'", "\\'") for a in allow]
    clean = " and ".join(["c.m rlike '[0-9]'", "c.m rlike '[A-Za-z]'", *(f"not c.m rlike '{a}'" for a in strings)])
    df = df.withColumn("_s_c", F.expr(f"filter({_places('entropy')}, c -> {clean})"))
    kinds = [f"transform(_s_{name}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, name in enumerate(base)]
    df = df.withColumn("_s_base", F.expr(f"concat({', '.join(kinds)})"))
    more = f"flatten(transform(_s_c, c -> transform({_windows()}, x -> named_struct('s', c.s + x.s, 'k', 3, 'e', c.s + x.e))))"
    df = df.withColumn("_s_more", F.expr(f"if(size(_s_c) = 0, cast(array() as array<struct<s:int,k:int,e:int>>), filter({more}, x -> not exists(_s_base, b -> b.s <= x.s and b.e >= x.e)))"))
    return df.withColumn("_spans", F.expr("array_sort(concat(_s_base, _s_more))")).drop(*[c for c in df.columns if c.startswith("_s_")])


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"concat_ws(',', transform({spans}, x -> concat_ws(':', element_at(array({names}), x.k + 1), x.s, x.e)))"


def secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy.

    spans are kind:start:end by start, then kind; see scan() for nulls and odd texts.  Rows that repeat give a row each.
    """
    df = scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), allow=allow)
    count = lambda k: F.expr(f"size(filter(_spans, x -> x.k = {k}))").cast("long")
    return df.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(F.expr(_joined("filter(_spans, x -> x.k < 3)")), 256).alias("base_sha256"),
        F.expr(_joined("_spans")).alias("spans"),
        count(3).alias("n_entropy"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one); n_chars follows where text changed.

    All columns, whatever their names, and all rows stay; texts without spans, null and empty ones are not touched.
    """
    df = scan(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text")))
    runs = """aggregate(_spans, cast(array() as array<struct<s:int,e:int>>), (acc, x) ->
      if(size(acc) > 0 and element_at(acc, -1).e >= x.s,
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e)))),
        concat(acc, array(named_struct('s', x.s, 'e', x.e)))))"""
    df = df.withColumn("_runs", F.expr(runs))
    new = f"""concat(array_join(transform(_runs, (x, i) -> concat(substr(text, if(i = 0, 0, _runs[i - 1].e) + 1, x.s - if(i = 0, 0, _runs[i - 1].e)), '{mark}')), ''),
      substr(text, element_at(_runs, -1).e + 1))"""
    df = df.withColumn("text", F.expr(f"if(size(_runs) = 0, text, {new})"))
    out = {c: F.col("row").getField(c) for c in docs.columns} | {"text": F.col("text")}
    if "n_chars" in out:
        out["n_chars"] = F.when(F.size("_runs") == 0, out["n_chars"]).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return df.select(*[v.alias(c) for c, v in out.items()])


def op1_secret_scans(spark, sf_dir):
    """The contract's query: every whole text of documents."""
    return secrets(table(spark, sf_dir, "documents"))
