"""Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns with clashing names, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from qspace.llm import chat_format, exact_dedup, line_dedup, mixing, near_dedup, quality, secret_scan, sentencepiece_bpe, token_store, toxicity

LONG = "word " * 60_000 + "\n" + "x" * 200_000
TEXTS = [(1, None), (2, ""), (3, " \t\n"), (4, "same text here"), (5, "same  text\there"), (5, "same  text\there"), (6, LONG), (None, "no id"), (7, "ÀÉ\x0b ß x"), (7, "other row of seven")]
#: Names that operators use inside or put out.
CLASH = "n long, size long, kept boolean, dig string, sig string, key string, part int, label int, rep long, __bucket int, `row` string, gone int, a int, h int, x double, ids int, score double, target int, copies int, __source string, __all int, tag string, bucket int, every int, extra int, id string, pos int, line string, b int, document int, body string, parts int"
SCHEMA = f"doc_id long, text string, source string, lang string, {CLASH}"
NO_LABELS = "doc_id long, quality int, toxic int"


def table(spark, rows):
    blank = (None,) * (len(CLASH.split(",")))
    return spark.createDataFrame([(i, t, None if i in (1, None) else f"s{i % 2}", "en", *blank) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).cache()


def labels(spark):
    return spark.createDataFrame([], NO_LABELS)


OPERATORS = {
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "lines": lambda s, d: line_dedup.line_dedup(d),
    "near": lambda s, d: near_dedup.near_dedup(d),
    "mix": lambda s, d: mixing.mix(d),
    "quality": lambda s, d: quality.quality(d, quality.train(d, labels(s))),
    "quality filter": lambda s, d: quality.quality_filter(d, quality.train(d, labels(s))),
    "toxicity": lambda s, d: toxicity.toxicity(d, toxicity.train(d, labels(s))),
    "scan": lambda s, d: secret_scan.scan(d, secret_scan.train(d)),
    "encode": lambda s, d: sentencepiece_bpe.encode_decode(d),
    "store": lambda s, d: token_store.store_round_trip(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_answered(spark, docs, name):
    got = OPERATORS[name](spark, docs).collect()
    assert len(got) == (len(TEXTS) if name != "quality filter" else 0)
    if name not in ("quality filter",):
        key = lambda v: (v is not None, v or 0)
        assert sorted((r["doc_id"] for r in got), key=key) == sorted((i for i, _ in TEXTS), key=key)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, table(spark, [])).count() == 0


def test_exact_groups(spark, docs):
    got = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_dedup(docs).collect()}
    by_id = {k[0]: v for k, v in got.items()}
    assert (by_id[5]["keep_id"], by_id[5]["group_size"], by_id[5]["kept"]) == (4, 3, False) and by_id[4]["kept"]
    assert (by_id[2]["keep_id"], by_id[2]["group_size"]) == (1, 2) and by_id[3]["keep_id"] == 3
    assert by_id[None]["kept"] and by_id[None]["keep_id"] is None


def test_lines_of_null_and_long_texts(spark, docs):
    got = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert (got[1]["n_lines"], got[1]["n_dropped"], got[1]["kept_text"]) == (1, 0, "")
    assert got[6]["kept_text"] == LONG and got[6]["n_lines"] == 2


def test_near_of_small_sets(spark, docs):
    got = {}
    for r in near_dedup.near_dedup(docs).collect():
        got.setdefault(r["doc_id"], r)
    assert got[1]["n_shingles"] == 0 and got[1]["component_id"] == 1 and got[2]["component_id"] == 2 and got[3]["kept"]
    assert got[5]["component_id"] == 4 and not got[5]["kept"] and got[4]["n_shingles"] == 1
    assert got[None]["component_id"] is None or got[None]["kept"]


def test_mix_of_nulls(spark, docs):
    got = mixing.mix(docs).collect()
    none = [r for r in got if r["source"] is None]
    assert {r["source_size"] for r in none} == {2} and all(r["taken"] <= 3 * r["size"] for r in got)


def test_other_columns_keep_their_values(spark):
    """What an operator returns beside its own columns is what it got, whatever the columns are called."""
    names = "__source __bucket __all __extra tag bucket every extra id row s n pos line a b document body gone parts".split()
    rows = [(i, f"text {i} of some words\nshared", f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    for out in (mixing.mix(df), line_dedup.line_dedup(df)):
        assert sorted(tuple(r)[: len(df.columns)] for r in out.select(*df.columns).collect()) == rows


def test_store_order(spark, docs):
    got = sorted(token_store.store_round_trip(docs).collect(), key=lambda r: r["start"])
    assert got[0]["doc_id"] is None and [r["doc_id"] for r in got[1:]] == sorted(r["doc_id"] for r in got[1:])
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_chat_cases(spark):
    schema = "conv_id long, turn long, role string, text string, part int, messages string, formatted string"
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, None, "assistant", ""), (2, 0, "a\nb\\|<|", "<|\\\\<|im_end|>")]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], schema)
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.chat_format(df)).collect()}
    assert [tuple(m) for m in back[1]["messages"]] == [("user", ""), ("", "x"), ("", "x")]
    assert [tuple(m) for m in back[None]["messages"]] == [("assistant", "")] and back[None]["loss_text"] == ""
    assert [tuple(m) for m in back[2]["messages"]] == [("a\nb\\|<|", "<|\\\\<|im_end|>")]
    assert chat_format.chat_format(df.limit(0)).count() == 0


def brute_fold(events):
    """Final messages of (turn, seq, kind, role, text), folded one event after the other."""
    order = {k: i for i, k in enumerate(chat_format.KINDS)}
    events = [(t, s, order.get(k or "message", -1), r or "", x or "") for t, s, k, r, x in events]
    done = []
    for turn, _, rank, role, text in sorted((e for e in events if e[2] >= 0), key=lambda e: tuple((v is not None, v) for v in e)):
        if rank == 0 or not done or done[-1][0] != turn:
            done.append([turn, role, "" if rank == 3 else text])
        else:
            done[-1][2] = done[-1][2] + text if rank == 1 else text if rank == 2 else ""
    return [(r, x) for _, r, x in done]


def test_chat_logs_fold_as_one_by_one(spark):
    rng = random.Random(8)
    log = []
    for conv in range(30):
        for _ in range(rng.randint(1, 60)):
            kind = rng.choice([None, "message", "delta", "delta", "delta", "edit", "regenerate", "ack"])
            log.append((conv, rng.choice([None, 0, 1, 2, 70, 200]), rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 8]), kind, rng.choice(["user", "assistant", None]), rng.choice(["a", "<|", "b\n", None, ""])))
    log += [(77, 0, 1, "message", "user", "hello"), (77, 0, 2, "ack", "user", None), (78, 0, 1, "ack", "user", "x")]
    df = spark.createDataFrame(log, "conv_id long, turn long, seq long, kind string, role string, text string")
    made = chat_format.chat_format(df, seq_col="seq", kind_col="kind")
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert 78 not in got and [tuple(m) for m in got[77]["messages"]] == [("user", "hello")]
    for conv in {r[0] for r in log} - {78}:
        want = brute_fold([r[1:] for r in log if r[0] == conv])
        assert [tuple(m) for m in got[conv]["messages"]] == want
        assert got[conv]["loss_text"] == "".join(x for r, x in want if r == "assistant")


def test_long_conversation(spark):
    """Work grows with the turns, also of one conversation, and with the events of one turn."""
    n = 20_000
    one = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    back = chat_format.read_back(chat_format.chat_format(one)).first()
    assert [m["text"] for m in back["messages"]] == [f"t{i}" for i in range(n)] and back["loss_text"] == "".join(f"t{i}" for i in range(1, n, 2))
    deltas = spark.range(n).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.col("id").alias("seq"), F.lit("delta").alias("kind"), F.lit("user").alias("role"), F.lit("xy").alias("text"))
    assert chat_format.read_back(chat_format.chat_format(deltas, seq_col="seq", kind_col="kind")).first()["messages"][0]["text"] == "xy" * n


@pytest.mark.parametrize("rows", [TEXTS, []], ids=["odd rows", "no rows"])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    """Nulls, empty and long texts, repeated ids and rows, no rows, no labels: every stage answers, with the columns of documents."""
    import corpus_pipeline as pipeline

    data = [(i, t, "en", None if i in (1, None) else "s", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, step in pipeline.STAGES[:-1]:
        out = step(spark, docs, str(tmp_path))
        assert out.columns == list(pipeline.COLUMNS), name
        assert out.count() <= 3 * len(rows)
    assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(rows)
    assert pipeline.run(spark, str(tmp_path)).count() <= 3 * len(rows)
