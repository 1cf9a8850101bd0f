"""Which chosen terms a text holds: by spelling as by hash, without hashing or remembering what most texts are made of."""

import re

import numpy as np
from pyspark.sql import functions as F

from echograph.llm import toxicity

TEXTS = ["Scum of the earth, scummy!", "it's a_b O'Neil's 3.5\x1cz", "ΣΑΣ, ΟΔΟΣ. ''q''w'", "calm words\xa0here_there x--y", "", None, "scumbags' SCUM'S (scum) re-scum", "été_ÉTÉ\ud800 ſcum ﬁn İx"]


def test_words_are_those_of_the_pattern():
    whole = re.compile(r"[^\W_]+(?:'[^\W_]+)*")
    assert all(toxicity.words_of(t) == set(whole.findall((t or "").lower())) for t in TEXTS)


def test_terms_by_spelling_are_those_by_hash(monkeypatch):
    words = sorted({w for t in TEXTS for w in toxicity.words_of(t)})
    ids = np.array(sorted({t for w in words[::2] for t in toxicity.terms_of(w)}), np.int64)
    plain = toxicity.Chosen(ids)
    names = {x for t in TEXTS for x in plain.names(plain.held(t))}
    named = toxicity.Named(ids, frozenset(names))
    want = [np.array(sorted({k for k, i in enumerate(ids) if i in {t for w in toxicity.words_of(x) for t in toxicity.terms_of(w)}}), np.int64) for x in TEXTS]
    monkeypatch.setattr(toxicity, "_hash", None)  # no text is hashed
    assert all(map(np.array_equal, map(named.of, TEXTS), want)) and sum(map(len, want)) > len(ids)
    monkeypatch.undo()
    assert all(map(np.array_equal, map(plain.of, TEXTS), want))


def test_a_fitted_machine_knows_how_its_terms_are_spelled(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("word"), "id", F.when(F.col("id") % 2 == 0, F.lit(" calm other")).otherwise(F.lit(" scum, other"))).alias("text"))
    model = toxicity.fit(spark, docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    assert {"wscum", "wcalm"} <= model.names and sorted(map(toxicity._hash, model.names)) == model.ids.tolist()
    assert model.chosen().of("no SCUM here").tolist() == toxicity.Chosen(model.ids).of("no scum here").tolist() != []
