"""The pipeline's stages on odd rows, and the whole against its parts."""

import corpus_pipeline
from keelson.llm import decontaminate, quality_rules, secret_scan

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_odd_rows(spark, odd):
    plain = odd.select(*COLUMNS)
    for _, step in corpus_pipeline.STAGES[:-1]:
        for docs in (plain, plain.limit(0)):
            assert step(spark, docs, SF).columns == COLUMNS
            step(spark, docs, SF).collect()
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, plain, SF).count() == 12


def test_pipeline_keeps_what_every_stage_keeps(spark, documents):
    good = {r.doc_id for r in quality_rules.apply_rules(documents).where("kept").collect()}
    leaked = {r.doc_id for r in decontaminate.leak_report(spark, documents, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in rows}
    assert len(ids) == len(rows) and ids <= good - leaked
    texts = {r.doc_id: r.text for r in documents.collect()}
    alone = [i for i in good - leaked if sum(texts[i] == t for t in texts.values()) == 1]
    assert len(ids) >= 0.8 * len(alone)


def test_masked_text_is_what_gets_encoded(spark):
    from keelson.llm import bpe

    documents = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    row = next(r for r in secret_scan.scan(documents).collect() if r.spans)
    masked = corpus_pipeline.secrets(spark, documents.where(f"doc_id = {row.doc_id}"), SF).first()
    assert masked.text == row.redacted and masked.n_chars == len(row.redacted)
    back = bpe.decode(bpe.encode(spark.createDataFrame([masked])))
    assert back.first().decoded == masked.text


def test_pipeline_equals_brute_force(spark, documents):
    """Every row that comes out, from the stages' rules applied one document or one pair at a time."""
    from test_operators import brute_leaks, sha
    from tokenizers import Tokenizer

    from keelson.llm.bpe_core import resolve

    good = {r.doc_id for r in quality_rules.apply_rules(documents).where("kept").collect()}
    texts = {r.doc_id: r.text for r in documents.collect() if r.doc_id in good}
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    root = {i: i for i in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in texts:
        for j in texts:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    alone = {i: texts[i] for i in texts if find(i) == i}
    assert len(alone) < len(texts)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, _ in brute_leaks(sorted(alone.items()), items)}
    library = Tokenizer.from_file(resolve("byte_bpe_50k.json"))
    want = {}
    for i, t in alone.items():
        if i not in leaked:
            masked = secret_scan.redact(t, secret_scan.base_spans(t) + secret_scan.confirmed_spans(t))
            ids = library.encode(masked, add_special_tokens=False).ids
            want[i] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_a_run_releases_its_own_tables_only(spark):
    from keelson.llm.shared import release_all, stage, staging

    with staging() as outer:
        other, path = stage(spark, spark.range(3), "other")
        with staging() as inner:
            _, gone = stage(spark, spark.range(5), "gone")
            kept, kept_path = stage(spark, spark.range(7), "kept")
            release_all(spark, inner, kept_path)
        assert inner == [kept_path] and outer == [path, kept_path]
    assert other.count() == 3 and kept.count() == 7
    assert spark.sparkContext._jvm.java.io.File(gone.removeprefix("file://")).exists() is False


def test_workers_hold_little_of_a_batch(spark):
    """What the last two stages hold of a batch at a time, and that no row is lost or changed by it."""
    import pyarrow as pa

    from keelson.llm import bpe_core
    from keelson.llm.shared import runs

    texts = ["ab" * 30, None, "", "é" * 200, "c"] * 7
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts, pa.string())})
    parts = [p.column("t").to_pylist() for p in runs(batch, "t", 100)]
    assert sum(parts, []) == texts and max(len(p) for p in parts) < 6
    assert all(sum(len((x or "").encode()) for x in p) <= 100 or len(p) == 1 for p in parts)
    assert list(runs(batch.slice(0, 0), "t", 100)) == []

    vocabulary = bpe_core.Vocabulary("byte_bpe_50k.json")
    library, sizes = vocabulary.library, []

    class Counting:
        def encode_batch_fast(self, words, **options):
            sizes.append(len(words))
            return library.encode_batch_fast(words, **options)

    vocabulary.library = Counting()
    table = bpe_core.WordTable(vocabulary)
    words = [f" w{k}" for k in range(12_000)]
    table.add(words)
    assert max(sizes) <= 5_000 and sum(sizes) == 12_000
    assert not {"merged", "merge_rank", "id_of"} & set(vars(vocabulary))  # made when first asked for
    for w in words[::997]:
        k = table.row[w]
        assert table.ids[table.start[k] : table.start[k] + table.size[k]].tolist() == library.encode(w, add_special_tokens=False).ids == vocabulary.merge(w.encode())


def test_scan_of_null_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "token = abcdefgh", "y")], "doc_id int, text string, redacted string")
    rows = sorted(secret_scan.scan(docs).collect())
    assert [(r.doc_id, r.text, r.n_assign, r.redacted) for r in rows] == [(1, None, 0, ""), (2, "token = abcdefgh", 1, "[SECRET]")]
    rows = sorted(secret_scan.scan(docs, text="redacted").collect())
    assert [(r.doc_id, r.text, r.redacted) for r in rows] == [(1, None, "x"), (2, "token = abcdefgh", "y")]
