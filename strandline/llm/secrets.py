"""Secret scans with DataFrame functions only.

Base kinds are found by patterns. What they leave is searched for maximal runs of key characters of ``MIN_LENGTH`` or more;
each is a candidate, whatever it is made of. Its encoding is inferred (the smallest alphabet that holds it), and three
tests ask how far it is from a uniform draw: chi-squared uniformity, over the alphabet and over its cells (vowels, common
and rare consonants, capitals, digits, symbols); runs of character classes; and serial correlation, of vowels and of
neighbouring codes. The squares of their z values add up to a distance that stays near 6 for a key of any length and grows
with the length of a natural identifier. ``NULL_LAW`` is the law of its root among natural identifiers (camel case, slugs,
paths, constants, words with digits, dates, versions, plain numbers), measured on sums, so that the correlation of the
tests is in it; the chance of a distance as small is the candidate's p-value, and a Benjamini-Hochberg step with length
weights (longer runs carry more evidence) holds the false-discovery rate among the candidates of each text. What passes
is a span of kind ``random``.

Defined results: null or empty text has no spans; repeated rows are scanned one by one; ties in start are in the order
assign, access, hex, random; equal p-values pass or fail together but for the order of their starts; candidates are runs
outside base spans; other columns are not read. Positions are code points, ends exclusive. Very long texts are cut into
pieces of bounded length once, so that no span costs a walk through its text. There is no shuffle and nothing goes to the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns (an access or hex run below its least length can be left out of the pattern, as a
#: match is always a whole run) and the order of kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGN_VALUE, MIN_LENGTH, FALSE_DISCOVERY = 12, 16, 0.01
CANDIDATE = rf"[A-Za-z0-9+/_-]{{{MIN_LENGTH},}}+"
#: Encodings from small to large: the pattern that infers them, whether case is folded, and the alphabet in code order.
ENCODINGS = {
    "hex": ("^(?:[0-9a-f]+|[0-9A-F]+)$", True, "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+$", True, "abcdefghijklmnopqrstuvwxyz234567"),
    "base36": ("^(?:[0-9a-z]+|[0-9A-Z]+)$", True, "abcdefghijklmnopqrstuvwxyz0123456789"),
    "base62": ("^[0-9A-Za-z]+$", False, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("", False, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Cells of the alphabets, and the class of characters that each belongs to.
CELLS = {"aeiou": "l", "nsrtldhcm": "l", "bfgjkpqvwxyz": "l", "AEIOU": "u", "BCDFGHJKLMNPQRSTVWXYZ": "u", "0123456789": "d", "+/": "s"}
#: The root of the distance among natural identifiers of n characters is about normal: (slope, level, deviation) for a mean
#: of slope * sqrt(n) + level. Set so that at most 1 % of each family above falls below its 1 % point (see the tests).
NULL_LAW = {"hex": (1.0, 0.7, 0.8), "base32": (1.33, -1.45, 0.75), "base36": (1.33, -1.45, 0.75), "base62": (1.38, -0.9, 0.9), "base64": (1.38, -0.9, 0.9)}
SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
_BLOCK, _PIECE = 256, 4096


def law(alphabet: str) -> dict[str, float | dict[str, float]]:
    """What a uniform draw from the alphabet expects: the share of each cell, changes of class and their variance (at
    distances 0 and 1), the share of vowels, and the mean and variance of codes."""
    size = len(alphabet)
    cells = {c: sum(x in alphabet for x in c) / size for c in CELLS}
    classes = {k: sum(p for c, p in cells.items() if CELLS[c] == k) for k in "luds"}
    two, three = (sum(p**k for p in classes.values()) for k in (2, 3))
    return {"cells": {c: p for c, p in cells.items() if p}, "change": 1 - two, "near": three - two * two, "mean": (size - 1) / 2, "var": (size * size - 1) / 12, "size": size}


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _with_spans_of(df: DataFrame, text: str, pattern: str, kind: int, into: str, value: bool = False, masked: str = "", found: str = "", only: Column | None = None) -> DataFrame:
    """Adds all matches as spans: the text is split at them, and the lengths of pieces and matches are summed up to each (in
    blocks, so that many matches don't cost their square). ``masked`` names the column in which the matches are blanked
    too, ``found`` one for the matches themselves; ``only`` says in which rows to look at all. Stage by stage, so that no expression is computed twice."""
    none, words = F.array().cast("array<bigint>"), F.array().cast("array<string>")
    there = F.col(text).rlike(pattern) if only is None else only & F.col(text).rlike(pattern)
    lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("bigint"))
    df = df.withColumns({
        "__x": F.when(there, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(words),
        "__g": F.when(there, F.split(text, pattern, -1)).otherwise(words),
        "__v": F.when(there, lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)))).otherwise(none) if value else none,
    })
    if masked:
        # blanks of the matches' lengths; what is no span (a short value) stays
        blank = F.transform("__x", lambda x, i: F.when(F.get("__v", i) < ASSIGN_VALUE, x).otherwise(F.repeat(F.lit(" "), F.length(x))) if value else F.repeat(F.lit(" "), F.length(x)))
        df = df.withColumn("__b", blank)
        df = df.withColumn(masked, F.when(F.size("__x") > 0, F.array_join(F.zip_with("__g", "__b", lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")).otherwise(F.col(text))).drop("__b")
    df = df.withColumns({"__m": lengths(F.col("__x")), "__g": lengths(F.col("__g"))})
    df = df.withColumn("__n", F.zip_with("__g", "__m", lambda a, b: a + F.coalesce(b, F.lit(0))))
    last = F.floor(F.size("__m") / _BLOCK).cast("int")
    df = df.withColumn("__t", F.transform(F.sequence(F.lit(0), last), lambda i: _total(F.slice("__n", i * _BLOCK + 1, F.lit(_BLOCK)))))
    span = lambda m, i: F.struct(
        (_total(F.slice("__t", F.lit(1), F.floor(i / _BLOCK).cast("int"))) + _total(F.slice("__n", F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK)) + F.get("__g", i)).alias("start"),
        F.lit(kind).alias("kind"),
        m.alias("end"),
    )
    df = df.withColumn(into, F.transform("__m", span))
    df = df.withColumn(into, F.transform(into, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), (x["start"] + x["end"]).alias("end"))))
    if value:
        df = df.withColumn(into, F.filter(into, lambda _, i: F.get("__v", i) >= ASSIGN_VALUE))
    if found:
        df = df.withColumn(found, F.col("__x"))
    return df.drop("__x", "__m", "__g", "__v", "__n", "__t")


def _normal_below(z: Column) -> Column:
    """The normal distribution's lower tail (logistic form, monotone, within a factor of two down to -4)."""
    return 1 / (1 + F.exp(-z * (1.5976 + 0.070566 * z * z)))


def _with_random(df: DataFrame, text: str, into: str) -> DataFrame:
    """Adds the spans that the test battery finds in the text, from which base spans are blanked."""
    df = _with_spans_of(df, text, CANDIDATE, 3, "__c", found="__run")
    df = df.withColumn("__c", F.zip_with("__c", "__run", lambda s, r: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), r.alias("run")))).drop("__run")
    laws = {name: law(alphabet) for name, (_, _, alphabet) in ENCODINGS.items()}

    def stage(**more) -> None:
        """Adds fields to each candidate."""
        nonlocal df, fields
        fields = [k for k in fields if k not in more]
        df = df.withColumn("__c", F.transform("__c", lambda s: F.struct(*[s[k].alias(k) for k in fields], *[f(s).alias(k) for k, f in more.items()])))
        fields = [*fields, *more]

    def by_encoding(s: Column, value) -> Column:
        """value(name) for the encoding that was inferred."""
        *first, last = ENCODINGS
        out = F.when(s["name"] == first[0], value(first[0]))
        for name in first[1:]:
            out = out.when(s["name"] == name, value(name))
        return out.otherwise(value(last))

    fields = ["start", "kind", "end", "run"]
    inferred = lambda s: F.coalesce(*[F.when(s["run"].rlike(p), F.lit(name)) for name, (p, _, _) in ENCODINGS.items() if p], F.lit("base64"))
    changes = lambda x: F.length(F.regexp_replace(x, r"(.)\1+", "$1")) - 1
    number = lambda s, cell: F.length(s["run"]) - F.length(F.translate(s["run"], cell, ""))
    cells = "".join(CELLS)
    classes = "".join(k * len(c) for c, k in CELLS.items())
    marks = "".join(("v" if c in ("aeiou", "AEIOU") else "c") * len(c) for c in CELLS)
    stage(name=inferred, n=lambda s: (s["end"] - s["start"]).cast("double"))
    stage(run=lambda s: F.when(s["name"].isin([k for k, (_, fold, _) in ENCODINGS.items() if fold]), F.lower(s["run"])).otherwise(F.translate(s["run"], "-_", "+/")))
    stage(
        alphabet=lambda s: by_encoding(s, lambda k: F.lit(ENCODINGS[k][2])),
        classes=lambda s: F.translate(s["run"], cells, classes),
        vowels=lambda s: F.translate(s["run"], cells, marks),
        chars=lambda s: F.filter(F.split(s["run"], ""), lambda c: c != ""),
        uniform=lambda s: by_encoding(s, lambda k: sum(((number(s, c) - s["n"] * p) * (number(s, c) - s["n"] * p) / (s["n"] * p) for c, p in laws[k]["cells"].items()), F.lit(0.0))),
        change=lambda s: by_encoding(s, lambda k: F.lit(laws[k]["change"])),
        near=lambda s: by_encoding(s, lambda k: F.lit(laws[k]["near"])),
        size=lambda s: by_encoding(s, lambda k: F.lit(float(laws[k]["size"]))),
    )
    mean, var = (lambda s: (s["size"] - 1) / 2), (lambda s: (s["size"] * s["size"] - 1) / 12)
    stage(
        squares=lambda s: F.aggregate(F.transform(F.array_distinct(s["chars"]), lambda c: s["n"] - F.length(F.replace(s["run"], c, F.lit("")))), F.lit(0.0), lambda a, c: a + c * c),
        codes=lambda s: F.transform(s["chars"], lambda c: F.instr(s["alphabet"], c) - 1 - mean(s)),
        share=lambda s: (s["n"] - F.length(F.translate(s["vowels"], "v", ""))) / s["n"],
        # each run of vowels has one pair less than letters
        pairs=lambda s: s["n"] - F.length(F.translate(s["vowels"], "v", "")) - (F.length(F.regexp_replace(s["vowels"], "v+", "v")) - F.length(F.translate(s["vowels"], "v", ""))),
    )
    stage(
        z_alphabet=lambda s: F.greatest((s["squares"] * s["size"] / s["n"] - s["n"] - (s["size"] - 1)) / F.sqrt(2 * (s["size"] - 1)), F.lit(0.0)),
        # one-sided: language keeps its class of characters, alternates vowels and consonants, and stays in one part of the alphabet
        z_runs=lambda s: F.least((changes(s["classes"]) - (s["n"] - 1) * s["change"]) / F.sqrt((s["n"] - 1) * s["change"] * (1 - s["change"]) + 2 * (s["n"] - 2) * s["near"]), F.lit(0.0)),
        z_vowels=lambda s: F.when((s["share"] > 0) & (s["share"] < 1), F.least(((s["pairs"] / (s["n"] - 1) - s["share"] * s["share"]) / (s["share"] * (1 - s["share"])) + 1 / s["n"]) * F.sqrt(s["n"]), F.lit(0.0))).otherwise(0.0),
        z_codes=lambda s: F.greatest(F.aggregate(F.zip_with(F.slice(s["codes"], F.lit(1), (s["n"] - 1).cast("int")), F.slice(s["codes"], F.lit(2), (s["n"] - 1).cast("int")), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) / var(s) / F.sqrt(s["n"] - 1), F.lit(0.0)),
    )
    stage(root=lambda s: F.sqrt(s["uniform"] + s["z_alphabet"] * s["z_alphabet"] + s["z_runs"] * s["z_runs"] + s["z_vowels"] * s["z_vowels"] + s["z_codes"] * s["z_codes"]))
    z = lambda s: by_encoding(s, lambda k: (s["root"] - NULL_LAW[k][0] * F.sqrt(s["n"]) - NULL_LAW[k][1]) / NULL_LAW[k][2])
    bounded = lambda s: F.greatest(F.least(z(s), F.lit(8.0)), F.lit(-8.0))
    df = df.withColumn("__c", F.transform("__c", lambda s: F.struct(_normal_below(bounded(s)).alias("p"), F.sqrt(s["n"]).alias("w"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    df = df.withColumn("__w", F.aggregate("__c", F.lit(0.0), lambda a, x: a + x["w"]) / F.greatest(F.size("__c"), F.lit(1)))
    df = df.withColumn("__c", F.array_sort(F.transform("__c", lambda x: F.struct((x["p"] * F.col("__w") / x["w"]).alias("q"), x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))))
    df = df.withColumn("__k", F.aggregate(F.transform("__c", lambda x, i: F.when(x["q"] <= (i + 1) * FALSE_DISCOVERY / F.size("__c"), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)))
    found = F.transform(F.slice("__c", F.lit(1), F.col("__k")), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return df.withColumn(into, found).drop("__c", "__k", "__w")


def _spans(documents: DataFrame, kept: Column) -> DataFrame:
    """__row (the kept columns), __text, __base and __all (spans: start, kind as an index of KINDS, end; sorted) for each row."""
    df = documents.select(kept.alias("__row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    df = df.withColumn("__rest", F.col("__text"))
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        df = _with_spans_of(df, "__text", pattern, kind, f"__s{kind}", value=kind == 0)
    df = df.withColumn("__base", F.array_sort(F.concat("__s0", "__s1", "__s2"))).drop("__s0", "__s1", "__s2")
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        df = _with_spans_of(df, "__rest", pattern, kind, "__s", value=kind == 0, masked="__blanked", only=F.size("__base") > 0).withColumn("__rest", F.col("__blanked")).drop("__s", "__blanked")
    df = _with_random(df, "__rest", "__r")
    # a generator of one row: later filters on the spans stop here, or they would copy the whole expression into themselves
    made = F.struct(F.col("__base").alias("__base"), F.array_sort(F.concat("__base", "__r")).alias("__all"))
    return df.select("__row", "__text", F.inline(F.array(made)))


def _joined(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat(F.element_at(kinds, s["kind"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of documents."""
    df = _spans(documents, F.col("doc_id"))
    number = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("long")
    return df.select(F.col("__row").alias("doc_id"), number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(_joined(F.col("__base")), 256).alias("base_sha256"), _joined(F.col("__all")).alias("spans"))


def redacted(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The columns of documents; each secret (overlapping spans together) is replaced by a mark. Clean texts stay as they are; n_chars, if there, follows."""
    names = documents.columns
    df = _spans(documents, F.struct(*[F.col(f"`{c}`").alias(c) for c in names]))
    df = df.withColumn("__pieces", F.when(F.size("__all") > 0, F.regexp_extract_all("__text", F.lit(rf"(?s).{{1,{_PIECE}}}"), F.lit(0))))

    def between(a: Column, b: Column) -> Column:
        """The text from a to b, out of the pieces that hold it."""
        first = F.floor(a / _PIECE).cast("int")
        own = F.slice("__pieces", first + 1, F.floor(b / _PIECE).cast("int") - first + 1)
        return F.substr(F.array_join(own, ""), (a % _PIECE + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    made = F.aggregate(
        "__all",
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(between(acc["at"], s["start"]), F.lit(mark)))).otherwise(acc["parts"]).alias("parts"),
        ),
    )
    changed = F.size("__all") > 0
    df = df.withColumn("__made", F.when(changed, made))
    new = F.when(changed, F.concat(F.array_join("__made.parts", ""), between(F.col("__made.at"), F.length("__text").cast("bigint")))).otherwise(F.col("__row.text"))
    out = df.select("__row", new.alias("__new"), changed.alias("__changed"))
    length = F.when(F.col("__changed"), F.length("__new").cast(dict(documents.dtypes).get("n_chars", "long"))).otherwise(F.col("__row.n_chars") if "n_chars" in names else F.lit(None))
    own = {"text": F.col("__new"), "n_chars": length}
    return out.select(*[(own[c] if c in own else F.col(f"__row.`{c}`")).alias(c) for c in names])
