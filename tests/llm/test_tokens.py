"""Tokens, packing and counts against the tokenizers themselves; the pipeline against its stages."""

import zlib

import numpy as np
import pyarrow as pa
import pytest

from tarmaq.llm import packing, textkit, token_counts, tokens

ODD = ["", " ", "a  b", "\n\nx\n", "a \n\nb  ", "it's  I'll\t\tgo ", "　x 　", "a\x1cb \x1c", "​ z", "日本 語\n", "<|endoftext|> a", "x" * 5000, " \n ", "don't \n\nstop 12,345.67!!", "word " * 3000]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids(reference, duck):
    texts = ODD + [r[0] for r in duck.execute("SELECT text FROM documents").fetchall()]
    for t in textkit.chunks(pa.array(texts), 1 << 18):
        e = tokens.encode(t, tokens.default_path())
        bounds = np.concatenate(([0], np.cumsum(e.counts())))
        flat = e.flat()
        for i in range(len(t)):
            assert flat[bounds[i] : bounds[i + 1]].tolist() == reference(texts[t.rows.start + i])


SPECIAL = ["a <|endoftext|> b", "a  <|endoftext|>  b\n\n<|endoftext|>x<|endoftext|><|endoftext|>\n", "<|endoftext|>", "\u3000<|endoftext|>\u3000 y", "<|endoftext| > <|endoftext|"]


def test_special_tokens(spark, tmp_path):
    """Ids, packed pieces and lengths of the registered queries are those of the tokenizer's default settings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    default = lambda x: own.encode(x, add_special_tokens=False).ids
    texts = [*SPECIAL, *ODD, " ".join(SPECIAL)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check_packing(list(enumerate(texts)), packing.op7_best_fit_packing(spark, str(tmp_path)).collect(), default)
    lengths = [len(default(x)) for x in texts]
    assert {r["length"]: r["n_docs"] for r in token_counts.op8_token_counts(spark, str(tmp_path)).collect()} == {n: lengths.count(n) for n in lengths}
    for t in textkit.chunks(pa.array(texts), 60):
        for path in (tokens.default_path(), public_tokenizers.path("byte_bpe_50k.json")):
            assert tokens.encode(t, path, specials=True).flat().tolist() == [i for x in texts[t.rows.start : t.rows.start + len(t)] for i in default(x)]


def test_words():
    texts = [*ODD, None, "a\x0bb\x0cc\rd", "\u0085x y"]
    for t in textkit.chunks(pa.array(texts), 40):
        w = textkit.words(t)
        for i in range(len(t)):
            own = [t.data[a:b].tobytes() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            assert own == (texts[t.rows.start + i] or "").encode().split()


def test_best_fit():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 1025, 3000)
    bins, offset, fills = packing.best_fit(sizes, 1024)
    for b in range(len(fills)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offset[own])]
        assert offset[own].tolist() == (np.cumsum(sizes[own]) - sizes[own]).tolist() and sizes[own].sum() == fills[b] <= 1024
    assert len(fills) <= 1.03 * sizes.sum() / 1024
    assert packing.cut(2500, 1024)[1].tolist() == [452, 1024, 1024] and packing.cut(2048, 1024)[1].tolist() == [1024, 1024] and packing.cut(0, 1024)[1].tolist() == [0]


def check_packing(rows, out, reference):
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.concatenate(([0], np.cumsum([n for _, n in own])[:-1])).tolist() and sum(n for _, n in own) <= 1024
    want = []
    for i, x in rows:
        ids = np.array([*reference(x or ""), 2], "<u4")
        for p, (s, n) in enumerate(zip(*packing.cut(len(ids), 1024), strict=True)):
            want.append((i, p, s, n, zlib.crc32(ids[s : s + n].tobytes())))
    assert sorted(map(repr, (tuple(r)[:5] for r in out))) == sorted(repr(tuple(x if x is None else int(x) for x in w)) for w in want)
    return len(bins), sum(n for own in bins.values() for _, n in own)


def test_packing(spark, reference, duck):
    texts = [r[0] for r in duck.execute("SELECT text FROM documents ORDER BY doc_id").fetchall()]
    rows = [(i, x) for i, x in enumerate([*texts, *ODD, None, texts[0]])] + [(0, texts[0]), (None, "a b"), (None, None)]
    docs = spark.createDataFrame([(*r, "bin", 1) for r in rows], "doc_id long, text string, bin string, piece int").repartition(7)
    n, _ = check_packing(rows, packing.pack(docs, fan_in=2).collect(), reference)
    whole = packing.best_fit(np.concatenate([packing.cut(len(reference(x or '')) + 1, 1024)[1] for _, x in rows]), 1024)[2]
    assert n <= 1.05 * len(whole) + 1  # seven small partitions; one alone packs as one pass does
    check_packing(rows, packing.pack(docs, node_items=20).collect(), reference)
    assert packing.pack(docs.limit(0)).isEmpty()


def test_packing_ends_where_nothing_merges(spark, monkeypatch):
    """More bins of 600 tokens than a node holds: none fits another, so the tree must end; later ones fit some."""
    calls = []
    real = packing.written

    def counted(df):
        calls.append(1)
        assert len(calls) < 40, "rounds without end"
        return real(df)

    monkeypatch.setattr(packing, "written", counted)
    rows = [(i, " a" * 599) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    out = packing.pack(docs, node_items=20).collect()
    assert sorted((r["doc_id"], r["length"], r["offset"]) for r in out) == [(i, 600, 0) for i in range(90)]
    assert len({r["sequence_id"] for r in out}) == 90
    calls.clear()
    mates = spark.createDataFrame([*rows, *((100 + i, " a" * 299) for i in range(90))], "doc_id long, text string").repartition(30)
    out = packing.pack(mates, node_items=20).collect()
    assert len(out) == 180 and len({r["sequence_id"] for r in out}) <= 100


def test_counts(spark, reference):
    rows = [(x,) for x in [*ODD, *ODD[:4], None]]
    docs = spark.createDataFrame(rows, "text string")
    lengths = np.array([len(reference(x or "")) for (x,) in rows])
    out = token_counts.context_limits(token_counts.histogram(docs)).collect()
    assert [r["length"] for r in sorted(out, key=lambda r: r["length"])] == sorted(set(lengths.tolist()))
    for r in out:
        k = r["length"]
        assert (r["n_docs"], r["docs_over"], r["tokens_upto"], r["truncated_tokens"]) == ((lengths == k).sum(), (lengths > k).sum(), lengths[lengths <= k].sum(), np.minimum(lengths, k).sum())
        assert r["n_tokens"] == k * r["n_docs"] and abs(r["quantile"] - (lengths <= k).mean()) < 1e-12
    assert token_counts.context_limits(token_counts.histogram(docs.limit(0))).isEmpty()


def test_pipeline(spark, sf, reference):
    """Each stage on its own input: what it may change, and that nothing else goes."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(stage(spark, seen[-1], sf).cache())
        if name != "best_fit_packing":
            assert seen[-1].columns == docs.columns, name
    start, clean, lined, one, mixed, packed = ({} if k is None else k for k in seen)
    ids = lambda df: {r["doc_id"] for r in df.collect()}
    assert ids(one) <= ids(lined) == ids(clean) <= ids(start) and ids(mixed) <= ids(one)
    text = {r["doc_id"]: r["text"] for r in one.collect()}
    copies = [(r["doc_id"], r["text"]) for r in mixed.collect()]
    assert all(text[i] == x for i, x in copies)
    before, after = (sum(len(x.split()) for x in s) for s in (text.values(), (x for _, x in copies)))
    assert abs(after - 1.5 * before) < 0.1 * before
    check_packing(copies, packed.collect(), reference)
