"""The toxicity grammar against a version without automaton or transducers, what it learns, and held-out rows."""

import re
import zlib

import duckdb
import numpy as np
import pytest

from qspace.llm import queries, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))


def plain_features(lexicon, text):
    """Each pattern is searched in each clause, and the grammar's rules are applied one by one."""
    low = toxicity.lowered(text)
    sums = dict.fromkeys(toxicity.FEATURES, 0.0)
    for clause in re.split(r"[.!?;:\n]+", low):
        words = toxicity.words_of(clause)
        padded, ends = f" {' '.join(words)} ", {}
        for i in range(len(words)):  # the place of each word's last sign
            ends[i] = 1 + len(" ".join(words[: i + 1])) - 1
        found = {}
        for p, (kind, weight) in lexicon.patterns.items():
            at = padded.find(p)
            while at >= 0:
                last = at + len(p) - 1 - (p[-1] == " ")
                i = next(i for i in range(len(words)) if last <= ends[i])
                found[i] = max(found.get(i, (0.0, "")), (weight, kind))
                at = padded.find(p, at + 1)
        left, said, target, plain = 0, False, False, 0.0
        for i, w in enumerate(words):
            role = lexicon.roles.get(w) if i not in found else None
            if i in found:
                weight, kind = found[i]
                sums["matched"] += weight
                if not left and not said:
                    plain += weight
                    sums["threat"] += weight * (kind == "threat")
            target = target or role == "target"
            said = said or role == "report"
            left = toxicity.SCOPE if role == "negation" else max(0, left - 1)
        end = toxicity.TARGET_WEIGHT if target and plain else 0.0
        sums["plain"] += plain
        sums["targeted"] += end
        sums["clauses"] += plain > 0
        sums["strongest"] = max(sums["strongest"], plain + end)
    if sums["plain"]:
        sums["density"] = 100 * sums["plain"] / len(toxicity.words_of(low))
    return [np.log1p(sums[f]) for f in toxicity.FEATURES]


def test_grammar():
    lexicon = toxicity.fixed_lexicon()
    lexicon.patterns |= {" zzba": ("insult", 1.0), " dark of ": ("insult", 1.0)}
    reader = toxicity.Reader(lexicon)
    f = lambda text: {k: v for k, v in zip(toxicity.FEATURES, reader.features(text), strict=True) if v}
    assert not f("a quiet day, idiotic or not") and not f("") and not f("the dark. Of night")
    assert f("You are an idiot.")["targeted"] > 0 and "targeted" not in f("Idiot! And you came.")
    assert set(f("you are not an idiot")) == {"matched"} and set(f("he said that they were idiots")) == {"matched"}
    assert "plain" in f("not so very long ago, idiot") and "plain" in f("a zzbarn came") and "plain" in f("the dark of night")
    assert "threat" in f("i will kill him") and "threat" not in f("never kill") and "plain" in f("what an id1ot")
    assert not f("und die Katze und die Maus")
    for text in ("you idiot, zzbazzba! not the dark of kill. he said: idiot; said the idiot", "nicht idiot idiot idiot idiot", "zzba\nnot\nzzbann"):
        assert reader.features(text) == pytest.approx(plain_features(lexicon, text))


def test_a_negation_or_report_lowers_the_score():
    reader = toxicity.Reader(toxicity.fixed_lexicon())
    score = lambda text: toxicity.Model(reader.lexicon, toxicity.PRIOR).score(np.array([reader.features(text)]))[0]
    assert score("hello there") < score("you are not an idiot") < score("you are an idiot") < score("you are an idiot, a moron and a loser")
    assert score("he wrote that you are an idiot") < score("you are an idiot")


def test_stems_are_found_and_others_left():
    rng = np.random.default_rng(1)
    syllables = ["ba", "ne", "ti", "ro", "ku", "sal", "men", "dor"]
    ordinary = ["".join(rng.choice(syllables, 3)) for _ in range(400)]
    words = [(w, 20, 20) for w in set(ordinary)] + [(f"vexul{s}", 12, 0) for s in syllables] + [("rokuba", 30, 30)]
    found = toxicity.induce(words, sum(w[1] for w in words), sum(w[2] for w in words))
    assert all(any(p in f" vexul{s} " for p in found) for s in (*syllables, "xyz"))
    assert not any(p in f" {w} " for p in found for w in ordinary)
    assert toxicity.induce([], 0, 0) == {}


def test_fit_never_weighs_below_zero():
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(300, len(toxicity.FEATURES))))
    w = toxicity.fit(x, (x[:, 0] < 0.5).astype(float), np.ones(300))
    assert (w[:-1] >= 0).all() and w[0] < 1e-6


def test_model_on_whole_documents(model):
    """Every document of a table against the plain version; and what negations and reports do to its score."""
    texts = [t or "" for (t,) in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    reader = toxicity.Reader(model.lexicon)
    for text in texts[::3]:
        assert reader.features(text) == pytest.approx(plain_features(model.lexicon, text))
    without = toxicity.Lexicon(model.lexicon.patterns, {w: r for w, r in model.lexicon.roles.items() if r not in ("negation", "report")})
    other = toxicity.Reader(without)
    a, b = (model.score(np.array([r.features(t) for t in texts])) for r in (reader, other))
    assert (a <= b).all() and (a < b).any()


def test_held_out(spark):
    got = queries.op3_toxicity(spark, SF).toPandas()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.itertuples()) and got.score.between(0, 1).all()
    got = got[got.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    toxic, clean = (got[got.toxic == v] for v in (1, 0))
    assert (toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]).mean() > 0.9
    assert toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.02
