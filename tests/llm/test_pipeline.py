import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parent.parent.parent), str(Path(__file__).parent.parent), str(Path(__file__).parent)]

import corpus_pipeline  # noqa: E402
from oracle import DATA, connection, rows_of, rows_of_sql  # noqa: E402

from skeinworks.llm import queries, simhash_dedup  # noqa: E402


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    assert rows_of(df, columns) == rows_of_sql(connection(), queries.ORACLE_SQL[name], columns)


def test_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {name: [i for i, _ in rows] for name, rows in kept.items()}
    all_ = [r.doc_id for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert set(ids["language_id"]) == {i for i in all_}  # every text here has letters
    norms = ["".join((t or "").split()) for _, t in kept["exact_dedup"]]
    assert len(norms) == len(set(norms)) == len({"".join((t or "").split()) for _, t in kept["language_id"]})
    near = simhash_dedup.near_duplicates(spark.createDataFrame(kept["near_dedup"], "doc_id long, text string")).collect()
    assert len({r.component_id for r in near}) == len(near)
    assert max(ids["mixing"].count(i) for i in set(ids["mixing"])) <= 2


def planted(spark, folder):
    """The documents and some more: copies, near copies, nulls, texts without a letter, a null source."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = [tuple(r) for r in docs.collect()]
    base = max((t for _, t, *_ in rows if t and len(t.split()) < 400), key=lambda t: len(t.split()))
    more = [None, "", "123 456 ?!", f"  {base}\n", base.replace(" ", "\t"), base.replace(base.split()[7], "quitenew", 1), " ".join([*base.split()[:-1], "another"]), "a short one"]
    rows += [(10_000_000 + k, t, "en", None if k % 3 == 0 else "planted", None) for k, t in enumerate(more)]
    spark.createDataFrame(rows, docs.schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return rows


def test_every_stage_against_a_plain_version(spark, tmp_path):
    import hashlib

    import numpy as np
    from test_operators import jaccard_groups
    from tokenizers import Tokenizer

    rows = planted(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)

    # language_id: every text with a letter is kept here
    want = [(i, t, s) for i, t, _, s, _ in rows if any(map(str.isalpha, t or ""))]
    assert plain(stage["language_id"](spark, docs, DATA)) == sorted(want, key=str)

    # exact_dedup: the longest, then the least id of texts that are equal without white space
    best = {}
    for r in want:
        key = "".join(c for c in r[1] if c not in " \t\n\x0b\x0c\r")
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0]))
    kept = sorted(best.values(), key=str)
    full = {r[0]: r for r in rows}
    frame = lambda some: spark.createDataFrame([full[r[0]] for r in some], docs.schema)
    assert plain(stage["exact_dedup"](spark, frame(want), DATA)) == kept and len(kept) < len(want)

    # near_dedup: the least id of each group over all pairs
    groups, pairs = jaccard_groups([t for _, t, _ in kept])
    least = {}
    for k, r in enumerate(kept):
        least[groups.top(k)] = min(least.get(groups.top(k), r), r)
    left = sorted(least.values(), key=str)
    assert plain(stage["near_dedup"](spark, frame(kept), DATA)) == left and pairs

    # mixing: copies by the SQL of op5
    con = connection(str(tmp_path / "none"))
    con.register("documents", frame(left).toPandas())
    taken = con.sql(queries.OP5_SQL).fetchall()
    copies = {i: took // size for i, size, *_, took in taken if size}
    mixed = plain(stage["mixing"](spark, frame(left), DATA))
    assert all(sum(m[0] == i for m in mixed) == n for i, n in copies.items()) and {m[0] for m in mixed} <= set(copies)

    # bpe: as the library; and run() is all of it
    library = Tokenizer.from_file(queries.vocabulary_path())

    def encoded(some):
        out = []
        for i, text, _ in some:
            ids = library.encode(text, add_special_tokens=False).ids
            out.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        return sorted(out)

    ran = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, ran)) == encoded(mixed)


def test_run(spark):
    found = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(found.columns) and found.count() > 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_hand_python_few_texts_at_a_time(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, 10000)
        docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
        assert corpus_pipeline.encode(spark, docs, "").count() == 2
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, before)
