"""License scan by ordered signature rules, with built-in functions only.

Texts are brought to one form, lower-case words with single spaces. A keyword
decides which rules' patterns are run at all; of detections that lie within another one
the outer one stays, of equal ones the one of the first rule.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phrasemine.llm.license_rules import PHRASES, Rule, rules

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASE = " (?:" + "|".join(p for p, _ in PHRASES) + ")(?= )"
OPEN, CLOSE = "\x01", "\x02"  # no word has them
PART = 128
DETECTION = "array<struct<start:bigint,back:bigint,priority:int,label:string,confidence:double>>"


def spaces(text: Column) -> Column:
    """Number of words that a piece of normalised text begins."""
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, also where lambdas inside refer to it."""
    return F.transform(F.array(value), use)[0]


def rule_array(all_rules: Sequence[Rule]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(r.priority).alias("priority"),
                F.lit(r.label).alias("label"),
                F.lit(r.keyword).alias("keyword"),
                F.lit(r.pattern + "(?= )").alias("pattern"),
                F.lit(r.confidence).alias("confidence"),
            )
            for r in all_rules
        ]
    )


def keywords_in(norm: Column, all_rules: Sequence[Rule]) -> Column:
    words = sorted({r.keyword for r in all_rules})
    return F.filter(F.array(*[F.lit(k) for k in words]), lambda k: F.contains(norm, k))


def detections(norm: Column, present: Column, all_rules: Sequence[Rule]) -> Column:
    """``(start, back, priority, label, confidence)`` of every match; ``back`` is the end, negated to sort long ones first.

    Signs that no word has are set around each match, so that among the pieces between spaces
    the one before a match and its last one carry them, and their places are those of the words.
    """

    def matches(rule: Column) -> Column:
        signed = F.regexp_replace(norm, F.concat(F.lit("("), rule["pattern"], F.lit(")")), F.lit(OPEN + "$1" + CLOSE))
        places = F.transform(F.split(signed, " ", -1), lambda w, at: F.struct(w.alias("w"), at.cast("long").alias("at")))
        starts = F.filter(places, lambda p: F.contains(p["w"], F.lit(OPEN)))
        ends = F.filter(places, lambda p: F.contains(p["w"], F.lit(CLOSE)))
        return F.zip_with(
            starts,
            ends,
            lambda a, b: F.struct(
                a["at"].alias("start"),
                (-b["at"]).alias("back"),
                rule["priority"].alias("priority"),
                rule["label"].alias("label"),
                rule["confidence"].alias("confidence"),
            ),
        )

    def of_rules(known: Column) -> Column:
        some = lambda r: F.array_contains(known, r["keyword"]) & F.rlike(norm, r["pattern"])
        return F.flatten(F.transform(F.filter(rule_array(all_rules), some), matches))

    return bound(present, of_rules)


def outermost(found: Column) -> Column:
    """Of sorted detections those that lie within no other; of equal spans the first rule's.

    A part of PART is folded by itself, and parts are joined, so that arrays are not copied for every detection.
    """

    def start(end: Column) -> Column:
        return F.struct(end.alias("end"), F.array().cast(DETECTION).alias("out"))

    def step(acc: Column, d: Column) -> Column:
        inside = -d["back"] <= acc["end"]
        return F.struct(
            F.greatest(acc["end"], -d["back"]).alias("end"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], F.array(d))).alias("out"),
        )

    def join(acc: Column, part: Column) -> Column:
        more = F.aggregate(part, start(acc["end"]), step)
        return bound(more, lambda m: F.struct(m["end"].alias("end"), F.concat(acc["out"], m["out"]).alias("out")))

    def parts(ordered: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)), F.lit(PART))
        return F.transform(firsts, lambda at: F.slice(ordered, at, F.lit(PART)))

    return F.aggregate(bound(found, parts), start(F.lit(0).cast("long")), join, lambda acc: acc["out"])


def scan_licenses(docs: DataFrame, all_rules: Sequence[Rule] | None = None) -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``detections``, ``labels`` and ``score``.

    Null and empty texts have no words and no labels (empty strings), null
    ``first_word`` and ``last_word``, and score 0. Every row is judged by itself,
    so repeated rows get equal results. Columns of ``docs`` with the names of the new ones are replaced.
    The score is the greatest confidence of what was detected.
    """
    all_rules = rules() if all_rules is None else list(all_rules)
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score"]
    lowered = F.translate(F.coalesce(F.col("text"), F.lit("")), CAPITALS, CAPITALS.lower())
    rows = docs.drop(*new).withColumn("__low", lowered).withColumn(
        "n_words", F.regexp_count("__low", F.lit(WORD)).cast("long")
    )
    # Every pattern needs one of the rules' keywords or a phrase, whose first words tell enough here.
    hints = sorted({r.keyword.split(" ")[0] for r in all_rules} | {p.split(" ")[0] for p, _ in PHRASES})
    hint = F.lit(False)
    for k in hints:
        hint = hint | F.contains("__low", F.lit(k))
    words = F.regexp_extract_all("__low", F.lit(WORD), F.lit(0))
    norm = F.when(hint, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).otherwise(F.lit(" "))
    rows = rows.withColumn("__norm", norm).drop("__low")
    rows = rows.withColumn("__present", keywords_in(F.col("__norm"), all_rules))

    rows = rows.withColumn("__found", F.array_sort(detections(F.col("__norm"), F.col("__present"), all_rules)))

    base = F.regexp_extract_all("__norm", F.lit(PHRASE), F.lit(0))
    tail = F.element_at(F.split("__norm", PHRASE, -1), -1)
    before = F.element_at(F.split("__norm", PHRASE, 2), 1)
    rows = rows.withColumn("__base", base)
    some = F.size("__base") > 0
    rows = rows.withColumns(
        {
            "n_base": F.size("__base").cast("long"),
            "first_word": F.when(some, spaces(before)),
            "last_word": F.when(
                some, F.col("n_words") - (spaces(tail) - 1) - spaces(F.element_at("__base", -1))
            ),
            "__labels": F.array_compact(
                F.array(*[F.when(F.array_contains("__base", f" {p}"), F.lit(label)) for p, label in PHRASES])
            ),
            "detections": outermost(F.col("__found")),
        }
    )
    named = F.transform("detections", lambda d: d["label"])
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return rows.withColumns(
        {
            "base_labels": F.array_join(F.array_sort("__labels"), ","),
            "labels": F.array_join(F.array_sort(F.array_distinct(F.concat("__labels", named))), ","),
            "score": F.greatest(sure, F.when(some, F.lit(0.8)).otherwise(F.lit(0.0))),
            "detections": F.transform(
                "detections",
                lambda d: F.struct(
                    d["start"].alias("first"), (-d["back"] - 1).alias("last"), d["label"].alias("label")
                ),
            ),
        }
    ).drop("__norm", "__present", "__found", "__base", "__labels")


def op6_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_licenses(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )
