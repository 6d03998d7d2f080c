"""Licence families of paragraphs by a trained classifier, with DataFrame operations only.

Sparse word n-grams are weighed by multinomial logistic regression. Training paragraphs are found by the templates below:
near-complete template texts are examples of their family; paragraphs that name licensing words without any template are
examples of ``unknown``; a bounded sample of the others is ``none``. Probabilities are calibrated by a temperature chosen on
examples that training doesn't see. A predicted family counts only if its template's n-grams confirm it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runframe.functions.runtime import cut
from runframe.llm.common import RESULT, apart, row_key

#: Short notices of licence families, after lower-casing.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license, version 2.0"),
    ("apache-2.0", "you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0"),
    ("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("cc-by", "licensed under cc by 4.0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("cc-by-nc", "licensed under cc by-nc 4.0"),
    ("cc-by-nc", "licensed under a creative commons attribution-noncommercial 4.0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license, version 3"),
    ("gpl-3.0", "this program is free software: you can redistribute it under the terms of the gnu general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mozilla-2.0", "subject to the terms of the mozilla public license, version 2.0"),
    ("reserved", "all rights reserved"),
)
#: Words that make a paragraph without a template an example of an unknown licence.
CUES = ("license", "licence", "licensed", "licenced", "copyright", "copyrighted", "spdx")
FAMILIES = tuple(sorted({f for f, _ in TEMPLATES}))
CLASSES = ("none", "unknown", *FAMILIES)
FEATURES = 1 << 14


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]+(?:[.-][a-z0-9]+)*)"), F.lit(1))


def _ngrams(words: Column, most: int = 3) -> Column:
    """Distinct runs of one to ``most`` words."""
    runs = [words]
    for n in range(2, most + 1):
        runs.append(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))),
                                         lambda i: i + F.lit(n - 1) <= F.size(words)),
                                lambda i: F.array_join(F.slice(words, i, F.lit(n)), " ")))  # noqa: B023
    return F.array_distinct(F.concat(*runs))


def template_shares(texts: DataFrame) -> DataFrame:
    """(paragraph, shares) of distinct texts that hold any n-gram of a template.

    ``shares`` maps a family to the largest share of one of its templates' n-grams that the text holds. The templates
    are a fixed list, so their side of the join is small.
    """
    grams = lambda c: F.explode(_ngrams(_words(F.col(c))))
    known = (texts.sparkSession.createDataFrame([(i, f, t) for i, (f, t) in enumerate(TEMPLATES)], "t int, family string, template string")
             .select("t", "family", grams("template").alias("gram"), F.size(_ngrams(_words(F.col("template")))).alias("size")))
    held = texts.select("paragraph").distinct().select("paragraph", grams("paragraph").alias("gram")).join(F.broadcast(known), "gram")
    share = held.groupBy("paragraph", "t", "family").agg((F.count(F.lit(1)) / F.first("size")).alias("share"))
    return (share.groupBy("paragraph", "family").agg(F.max("share").alias("share")).groupBy("paragraph")
            .agg(F.map_from_entries(F.collect_list(F.struct("family", "share"))).alias("shares")))


def paragraphs(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, key, no, paragraph) of every line that isn't blank; a null text has none."""
    return docs.select(F.col(id).cast("long").alias("doc"), row_key(id, text).alias("key"),
                       F.posexplode(F.split(text, "\n")).alias("no", "paragraph")).where(F.trim("paragraph") != "")


def _with_features(df: DataFrame, text: str = "paragraph") -> DataFrame:
    """Adds ``features``: hashed counts of the words and word pairs of a text."""
    from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer

    words = _once(RegexTokenizer(inputCol=text, outputCol="_w", gaps=False, pattern=r"[a-z0-9]+(?:[.-][a-z0-9]+)*").transform(df), "_w")
    both = NGram(n=2, inputCol="_w", outputCol="_b").transform(words).withColumn("_g", F.concat("_w", "_b"))
    done = HashingTF(numFeatures=FEATURES, inputCol="_g", outputCol="features", binary=True).transform(both)
    return _once(done.drop("_w", "_b", "_g"), "features")


def _cued() -> Column:
    return F.lower("paragraph").rlike(r"licen[sc]e|copyright|spdx|rights reserved|hereby granted|redistribut")


class LicenceModel:
    """A fitted regression with the temperature that calibrates it."""

    def __init__(self, regression, temperature: float):
        self.regression, self.temperature = regression, temperature

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` with ``p``: the calibrated probability of each class of ``CLASSES``."""
        from pyspark.ml.functions import vector_to_array

        raw = _once(self.regression.transform(_with_features(df)).select(*df.columns, vector_to_array("rawPrediction").alias("_r")), "_r")
        top = F.array_max("_r")
        total = F.aggregate("_r", F.lit(0.0), lambda a, x: a + F.exp((x - top) / self.temperature))
        p = F.transform("_r", lambda x: F.exp((x - top) / self.temperature))
        return (_once(raw.withColumn("_t", total), "_t").withColumn("p", F.transform(p, lambda x: x / F.col("_t"))).drop("_r", "_t"))


def _once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with some columns fixed: the optimiser would else repeat their expressions in every use."""
    kept = [c for c in df.columns if c not in names]
    return df.select(*kept, F.explode(F.array(F.struct(*names))).alias("_fixed")).select(*kept, "_fixed.*")


def _examples(docs: DataFrame, id: str, text: str, sample: int) -> DataFrame:
    """(paragraph, label) with at most ``sample`` paragraphs of each class, and what the templates themselves give."""
    rows = paragraphs(docs, id, text).select("paragraph")
    cued = rows.where(_cued()).where(F.length("paragraph") < 2000).distinct()
    best = F.array_max(F.transform(F.map_entries("shares"), lambda e: F.struct(e["value"].alias("value"), e["key"].alias("key"))))
    number = F.create_map(*[x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(i).cast("long"))])
    marked = cut(cued.join(template_shares(cued), "paragraph", "left").withColumn("b", best).select(
        "paragraph", F.when(F.col("b.value") >= 0.9, F.element_at(number, F.col("b.key")))
        .when(F.coalesce("b.value", F.lit(0.0)) < 0.5, F.lit(1).cast("long")).alias("label")).where("label IS NOT NULL"))
    order = F.xxhash64("paragraph")
    picks = [marked.where(F.col("label") == k).orderBy(order, "paragraph").limit(sample) for k in range(1, len(CLASSES))]
    picks.append(rows.where(~_cued()).orderBy(order, "paragraph").limit(4 * sample).select("paragraph", F.lit(0).cast("long").alias("label")))
    # a notice without the words that tell families apart names no known licence
    families: dict[str, set] = {}
    for family, template in TEMPLATES:
        for w in template.split():
            families.setdefault(w, set()).add(family)
    own = [(t, CLASSES.index(f)) for f, t in TEMPLATES for _ in range(20)]
    generic = [(" ".join(w for w in t.split() if len(families[w]) > 1 or w in CUES), 1) for _, t in TEMPLATES for _ in range(5)]
    generic += [(f"licensed under the {w} license", 1) for w in ("custom", "internal", "community", "vendor", "partner") for _ in range(5)]
    made = docs.sparkSession.createDataFrame([x for x in own + generic if x[0]], "paragraph string, label long")
    return reduce(DataFrame.unionByName, picks, made)


def train(docs: DataFrame, id: str = "doc_id", text: str = "text", sample: int = 300) -> LicenceModel:
    """Fits on at most ``sample`` paragraphs per class (four times as many without a licence); one in five calibrates."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    examples = _with_features(cut(_examples(docs, id, text, sample)))
    apart = F.pmod(F.xxhash64("paragraph", F.lit(3)), F.lit(5)) == 0
    # every class takes part: the templates' rows stay in training
    fitted = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", regParam=0.002, maxIter=40).fit(
        examples.where(~apart | F.lower("paragraph").isin([t for _, t in TEMPLATES])))
    if fitted.numClasses != len(CLASSES):
        raise ValueError("a class has no example")
    logits = fitted.transform(examples.where(apart)).select(vector_to_array("rawPrediction").alias("r"), F.col("label").cast("int").alias("y"))
    grid = [0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0]
    losses = []
    for t in grid:
        top = F.array_max("r") / t
        total = F.aggregate("r", F.lit(0.0), lambda a, x: a + F.exp(x / t - top))  # noqa: B023
        losses.append(F.avg(F.log(total) + top - F.get("r", F.col("y")) / t).alias(f"t{len(losses)}"))
    row = logits.agg(*losses).first()
    known = [(loss, t) for loss, t in zip(row, grid) if loss is not None]
    return LicenceModel(fitted, min(known)[1] if known else 1.0)


def scan_paragraphs(docs: DataFrame, model: LicenceModel, id: str = "doc_id", text: str = "text",
                    confirm: float = 0.6, sure: float = 0.5) -> DataFrame:
    """(doc, key, no, paragraph, licence, probability, share) of the paragraphs that carry a licence notice.

    A family needs the highest probability, at least ``sure``, and ``confirm`` of the n-grams of one of its
    templates; other paragraphs that are not rather ``none`` than anything else are ``unknown``.
    """
    scored = model.probabilities(paragraphs(docs, id, text))
    some = scored.where(F.get("p", F.lit(0)) < 0.5)
    best = F.array_max("p")
    some = cut(some.withColumn("_k", F.array_position("p", best).cast("int")).withColumn("probability", best).drop("p"))
    some = some.join(template_shares(some), "paragraph", "left")
    names = F.array(*[F.lit(c) for c in CLASSES])
    share = F.coalesce(F.try_element_at("shares", F.get(names, F.col("_k") - 1)), F.lit(0.0))
    good = (F.col("_k") > 2) & (F.col("probability") >= sure) & (share >= confirm)
    return some.select("doc", "key", "no", "paragraph", F.when(good, F.get(names, F.col("_k") - 1)).otherwise("unknown").alias("licence"),
                       "probability", share.alias("share"))


def license_scan(docs: DataFrame, id: str = "doc_id", text: str = "text", model: LicenceModel | None = None,
                 out: str = "licences") -> DataFrame:
    """``docs`` with a struct ``out``: n_paragraphs, n_notices, n_unknown, families (sorted, distinct).

    Null and empty texts have no paragraphs. Rows of equal id and text get the same result. A column named
    ``out`` is replaced.
    """
    return apart(docs, id, text, out, lambda own: _scanned(own, model or train(own)))


def _scanned(docs: DataFrame, model: LicenceModel) -> DataFrame:
    id, text, out, key, doc = "doc_id", "text", RESULT, "_key", "_doc"
    found = scan_paragraphs(docs, model, id, text).groupBy("doc", "key").agg(
        F.countDistinct("no").alias("_n"), F.collect_set(F.when(F.col("licence") == "unknown", F.col("no"))).alias("_u"),
        F.array_sort(F.collect_set(F.when(F.col("licence") != "unknown", F.col("licence")))).alias("_f"))
    base = docs
    joined = base.withColumn(key, row_key(id, text)).withColumn(doc, F.col(id).cast("long")).join(
        found, (F.col(key) == found["key"]) & F.col(doc).eqNullSafe(found["doc"]), "left")
    lines = F.when(F.col(text).isNull(), 0).otherwise(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    report = F.struct(lines.cast("long").alias("n_paragraphs"), zero(F.col("_n")).alias("n_notices"),
                      F.when(F.col("_u").isNull(), 0).otherwise(F.size("_u")).cast("long").alias("n_unknown"),
                      F.coalesce("_f", F.array().cast("array<string>")).alias("families"))
    return joined.select(*base.columns, report.alias(out))


def license_report(docs: DataFrame) -> DataFrame:
    found = license_scan(docs.select("doc_id", "text"))
    return found.select("doc_id", "licences.n_paragraphs", "licences.n_notices", "licences.n_unknown",
                        F.array_join("licences.families", ",").alias("families"))
