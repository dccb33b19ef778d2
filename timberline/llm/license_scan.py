"""License scans by ordered signature rules, in built-in functions only.

A text becomes its words in lower case (A-Z), one blank between them. One keyword pattern gates the rules: only texts that
hold a keyword are matched, and each only against the rules of its keywords (the fixed rule table is a literal of
the plan). Every place of a rule is found; a place contained in that of a rule before it in the order
(or in a longer one of the same priority) is suppressed. Base phrases always count.

Null and empty texts have no words and no labels; repeated rows are scanned each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.llm.common import lower_ascii
from timberline.llm.quality_rules import let

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_PATTERN = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
# Keywords that a version may follow without a blank; all others are whole words.
OPEN = ("agpl", "gpl", "lgpl")


def rules() -> list[tuple[int, str, str, str]]:
    """(priority, keyword, pattern over words, label); a lower priority number goes first."""
    out: list[tuple[int, str, str, str]] = []
    v = "(?:version |v ?)?"
    for name, full in (("gpl", "gnu general public license"), ("lgpl", "gnu lesser general public license"),
                       ("lgpl", "gnu library general public license"), ("agpl", "gnu affero general public license")):
        for number in ("1", "2", "2 1", "3"):
            label = f"{name}-{number.replace(' ', '.')}"
            out += [(10, "gnu", f"{full} (?:as published by the free software foundation )?(?:either )?{v}{number}(?: 0)? (?:of the license )?or (?:at your option )?any later", f"{label}-or-later"),
                    (20, "gnu", f"{full} {v}{number}(?: 0)? only", f"{label}-only"),
                    (30, "gnu", f"{full} {v}{number}(?: 0)?", label)]
        for number in ("1", "2", "3"):
            out += [(25, name, f"{name} ?(?:v|version )?{number}(?: 0)? or later", f"{name}-{number}-or-later"),
                    (26, name, f"{name} ?(?:v|version )?{number}(?: 0)? only", f"{name}-{number}-only"),
                    (35, name, f"{name} ?(?:v|version )?{number}(?: 0)?", f"{name}-{number}")]
        out.append((60, "gnu", full, name))
    for kind in ("", " sa", " nc", " nd", " nc sa", " nc nd"):
        label = "cc-by" + kind.replace(" ", "-")
        for number in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out += [(20, "cc", f"cc by{kind} {number}", f"{label}-{number.replace(' ', '.')}")]
        out.append((40, "cc", f"cc by{kind}", label))
    long_kinds = {"": "", " sharealike": "-sa", " share alike": "-sa", " noncommercial": "-nc", " non commercial": "-nc",
                  " noderivatives": "-nd", " noncommercial sharealike": "-nc-sa", " noncommercial noderivatives": "-nc-nd"}
    for words, kind in long_kinds.items():
        for number in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((20, "creative", f"creative commons attribution{words} {number}", f"cc-by{kind}-{number.replace(' ', '.')}"))
        out.append((40, "creative", f"creative commons attribution{words}", f"cc-by{kind}"))
    for name, keyword, forms, numbers in (
        ("apache", "apache", ("apache license", "apache software license", "apache public license", "apache"), ("1 0", "1 1", "2 0")),
        ("mpl", "mozilla", ("mozilla public license", "mozilla license"), ("1 0", "1 1", "2 0")),
        ("epl", "eclipse", ("eclipse public license", "eclipse license"), ("1 0", "2 0")),
        ("cddl", "cddl", ("common development and distribution license cddl", "cddl"), ("1 0", "1 1")),
        ("eupl", "european", ("european union public licence", "european union public license"), ("1 0", "1 1", "1 2")),
        ("osl", "open", ("open software license",), ("1 0", "2 0", "2 1", "3 0")),
        ("afl", "academic", ("academic free license",), ("1 1", "2 0", "2 1", "3 0")),
        ("artistic", "artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0")),
        ("bsl", "boost", ("boost software license",), ("1 0",)), ("ms-pl", "microsoft", ("microsoft public license",), ("1 0",)),
        ("gfdl", "documentation", ("gnu free documentation license",), ("1 1", "1 2", "1 3")),
        ("lppl", "latex", ("latex project public license",), ("1 0", "1 2", "1 3")),
        ("ofl", "font", ("sil open font license", "open font license"), ("1 0", "1 1")),
        ("zpl", "zope", ("zope public license",), ("1 1", "2 0", "2 1")), ("php", "php", ("php license",), ("3 0", "3 01")),
        ("cc0", "cc0", ("cc0",), ("1 0",)), ("cc0", "creative", ("creative commons zero",), ("1 0",)),
    ):
        for form in forms:
            for number in numbers:
                label = f"{name}-{number.replace(' ', '.')}"
                out += [(20, keyword, f"(?:licensed under (?:the )?)?{form} {v}{number}", label)]
            if form != "apache":
                out.append((50, keyword, form, name))
    for clauses, label in (("2", "bsd-2-clause"), ("3", "bsd-3-clause"), ("4", "bsd-4-clause")):
        out += [(20, "bsd", f"(?:the )?bsd {clauses} clause", label), (20, "bsd", f"{clauses} clause bsd", label)]
    for keyword, pattern, label in (
        ("bsd", "(?:new|modified|revised) bsd license", "bsd-3-clause"), ("bsd", "simplified bsd license", "bsd-2-clause"),
        ("bsd", "bsd license", "bsd"), ("bsd", "bsd style license", "bsd"), ("mit", "(?:the )?mit license", "mit"),
        ("mit", "(?:released|licensed|distributed) under (?:the )?mit", "mit"), ("spdx", "spdx license identifier [a-z0-9]+", "spdx"),
        ("permission", "permission is hereby granted free of charge", "mit"), ("isc", "isc license", "isc"),
        ("permission", "permission to use copy modify and or distribute this software", "isc"), ("zlib", "zlib license", "zlib"),
        ("redistribution", "redistribution and use in source and binary forms", "bsd"), ("unlicense", "unlicense", "unlicense"),
        ("public", "(?:released|placed|dedicated) (?:in|into|to) the public domain", "public-domain"), ("public", "public domain", "public-domain"),
        ("wtfpl", "wtfpl", "wtfpl"), ("copyright", "copyright (?:c )?[0-9]{4}", "copyright"), ("copyright", "copyright c", "copyright"),
        ("proprietary", "proprietary and confidential", "proprietary"), ("confidential", "strictly confidential", "proprietary"),
        ("rights", "all rights reserved", "reserved"), ("general", "general public license", "gpl"),
        ("noncommercial", "noncommercial use only", "non-commercial"), ("commercial", "non commercial use only", "non-commercial"),
        ("warranty", "provided as is without warranty", "no-warranty"), ("license", "see the license file", "license-file"),
    ):
        out.append((45, keyword, pattern, label))
    return list(dict.fromkeys(out))


def gate_pattern() -> str:
    """The keyword a word of a text is or, for OPEN ones, starts with; the boundary makes the order of the keywords irrelevant."""
    return "(?<= )(?:" + "|".join(k + ("(?=[ v0-9])" if k in OPEN else "(?= )") for k in sorted({k for _, k, _, _ in rules()})) + ")"


def blanks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def places(text: Column, pattern: Column, priority: Column, label: Column) -> Column:
    """Every place of a rule as structs (start, end, priority, label); starts come from the pieces between the matches."""
    def walk(found: Column, gaps: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>").alias("out"))
        step = lambda a, pair: F.struct(
            (a["at"] + F.char_length(pair["g"]) + F.char_length(pair["m"])).alias("at"),
            F.array_append(a["out"], F.struct(
                (a["at"] + F.char_length(pair["g"])).alias("start"), (a["at"] + F.char_length(pair["g"]) + F.char_length(pair["m"])).alias("end"),
                priority.alias("priority"), label.alias("label"))).alias("out"))
        pairs = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.aggregate(pairs, zero, step, lambda a: a["out"])

    return walk(F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, F.lit(-1)))


def scan(docs: DataFrame) -> DataFrame:
    gate = gate_pattern()
    spaced = F.concat(F.lit(" "), F.trim(F.regexp_replace(
        lower_ascii(F.coalesce("text", F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")), F.lit(" "))
    based = docs.select("doc_id", spaced.alias("t")).select("doc_id", F.when(F.col("t") != "  ", F.col("t")).otherwise(" ").alias("t"))
    some = F.col("t").rlike("|".join(BASE))
    head = F.regexp_instr("t", F.lit(BASE_PATTERN))
    tail = F.regexp_extract("t", f"(?s)^(.*){BASE_PATTERN}", 1)
    n_base = F.when(some, F.regexp_count("t", F.lit(BASE_PATTERN))).otherwise(0)
    rows = based.select(
        "doc_id", "t", (blanks(F.col("t")) - 1).cast("long").alias("n_words"), n_base.cast("long").alias("n_base"),
    ).withColumns({
        "first_word": F.when(F.col("n_base") > 0, (blanks(F.substring("t", F.lit(1), head - 1)) - 1).cast("long")),
        "last_word": F.when(F.col("n_base") > 0, (blanks(tail) - 1).cast("long")),
        "base": F.when(F.col("n_base") > 0, F.array_sort(F.filter(F.array(*[
            F.when(F.contains("t", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]), lambda x: x.isNotNull())))
        .otherwise(F.array().cast("array<string>")),
        # Rules are put together per keyword, so a text meets each rule once.
        "keys": F.when(F.col("t").rlike(gate), F.array_distinct(F.regexp_extract_all("t", F.lit(gate), F.lit(0)))).otherwise(F.array().cast("array<string>")),
    })
    table = [(k, [r for r in enumerate(rules()) if r[1][1] == k]) for k in sorted({k for _, k, _, _ in rules()})]
    # The table has a fixed number of rules; as an array it is a literal of the plan, and no join nor grouping is needed.
    entries = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(f"(?<= )(?:{x})(?= )").alias("x"), F.lit(label).alias("l"))
                        for k, found in table for _, (p, k, x, label) in found])
    spans = F.when(F.size("keys") > 0, F.flatten(F.transform(
        F.filter(entries, lambda r: F.array_contains(F.col("keys"), r["k"])),
        lambda r: places(F.col("t"), r["x"], r["p"], r["l"])))).otherwise(
            F.array().cast("array<struct<start:int,end:int,priority:int,label:string>>"))
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (
        (o["priority"] < s["priority"]) | ((o["priority"] == s["priority"]) & (o["end"] - o["start"] > s["end"] - s["start"])))
    left = let(spans, lambda all_spans: F.filter(all_spans, lambda s: ~F.exists(all_spans, lambda o: inside(s, o))))
    named = let(left, lambda kept: F.struct(F.array_distinct(F.transform(kept, lambda s: s["label"])).alias("labels"), F.aggregate(
        kept, F.lit(0), lambda a, s: a + s["end"] - s["start"]).alias("covered"), F.size(kept).alias("n_places")))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", named.alias("found"), F.char_length("t").alias("size")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.col("found.labels"))), ",").alias("labels"),
        F.least(F.lit(1.0), F.when((F.size("base") > 0) | (F.col("found.n_places") > 0), 0.5).otherwise(0.0)
                + 0.5 * F.col("found.covered") / F.col("size")).alias("score"), F.col("found.n_places").cast("long").alias("n_places"))
