"""Token alignment, quality from positives and unlabelled text, and whitening, against plain versions on small tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import alignment, pu_quality, whitening

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ------------------------------------------------------------------ alignment


def plain_tokens(text):
    """(ids, ends) of both tokenizers over the whole text, or None where it has no tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    own = alignment.pair_of(A, B)
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    a = a.encode(" " + text, add_special_tokens=False).ids
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    b = sp.encode(text)
    pieces = [sp.id_to_piece(i) for i in b]
    raw = b"".join(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True))
    if raw != (" " + text).encode() or "▁" in text:
        return None
    la = [len(own.a.fast.decode_single_token_bytes(i)) for i in a]
    lb = [1 if sp.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in zip(b, pieces, strict=True)]
    return a, np.cumsum(la).tolist(), b, np.cumsum(lb).tolist()


def plain_alignment(texts):
    found, counts = [], collections.Counter()
    for text in texts:
        t = plain_tokens(text)
        if t is None:
            found.append(None)
            continue
        a, ea, b, eb = t
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if sa[i] < eb[j] and sb[j] < ea[i]]
        counts.update(links)
        groups, cut = [], 0
        for e in sorted(set(ea) & set(eb)):
            groups.append(",".join(str(x) for x, y in zip(a, ea, strict=True) if cut < y <= e) + "|" + ",".join(str(x) for x, y in zip(b, eb, strict=True) if cut < y <= e))
            cut = e
        found.append((len(a), len(b), groups, links))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    return [(0,) * 6 + ("",) if f is None else (f[0], f[1], len(f[2]), len(f[3]), sum(counts[x] == highest[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), ";".join(f[2])) for f in found]


PIECES = ["The", "of", "internationalization", "don't", " ", "  ", "\n", " \n ", "\t", "é", "über", "日本語のテキスト", "🙂", "<|endoftext|>", "<s>", "<0x41>", "1234567", "...", "a b", "　", " ", "x‍y", "'s", "ﬁ", "\x00", "#include", "=" * 30]


def test_spans_keep_the_tokens_of_both_tokenizers():
    own = alignment.pair_of(A, B)
    assert own.as_it_is
    r = random.Random(4)
    for _ in range(600):
        text = "".join(r.choice(PIECES) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randint(1, 12)))
        assert own.whole(text) == (bool(text) and own.b.normalize(text) == "▁" + text.replace(" ", "▁"))
        if not own.whole(text):
            continue
        spans = alignment.spans_of(text)
        assert " " + text == "".join(" " + s for s in spans)
        assert [i for s in spans for i in own.encode_a(" " + s)] == own.encode_a(" " + text), repr(text)
        assert [i for s in spans for i in own.b.encode(s)] == own.b.encode(text), repr(text)


@pytest.mark.parametrize("frequent", [0, 5, 1 << 17])
def test_alignment_equals_plain_version(spark, frequent):
    r = random.Random(9)
    texts = [None, "", " ", "a", "a ", " a", "the cat\nsat", "x▁y", "same text here", "same text here", "日本語のテキストです" * 60, "ab" * 3000, "=" * 500 + "x" * 77, "<|endoftext|> <s> </s>"]
    texts += ["".join(r.choice(PIECES) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randint(1, 25))) for _ in range(60)]
    rows = [(None if k == 3 else k, t, "x", 7) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, span string, n_a int").repartition(3)
    got = alignment.align(docs, A, B, frequent=frequent)
    assert got.columns == ["doc_id", *alignment.NUMBERS, "groups"]
    want = plain_alignment(texts)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted([(k, *w) for (k, *_), w in zip(rows, want, strict=True)], key=key)


def test_tokens_are_sorted_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(alignment, "DEALT", 50, raising=False)
    docs = spark.createDataFrame([(k, f"w{k} x{k} y{k}") for k in range(200)], "doc_id long, text string")
    tokens = alignment.tokenized(alignment.span_counts(docs, A, B, "text"), A, B).localCheckpoint()
    assert tokens.count() == 600
    assert alignment.token_ends(tokens).rdd.getNumPartitions() == 12


def test_alignment_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(empty, A, B).count() == 0
    nulls = spark.createDataFrame([(1, None), (1, "")], "doc_id long, text string")
    assert [tuple(r) for r in alignment.align(nulls, A, B).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_alignment_query(spark):
    from tessera.llm import queries

    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op11_alignment(spark, folder).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 1500").collect()]
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for k, text in texts[:60]:
        n_a, n_b, n_groups, n_links, *_, groups = plain_alignment([text])[0]
        assert (got[k]["n_a"], got[k]["n_b"], got[k]["n_groups"], got[k]["n_links"]) == (n_a, n_b, n_groups, n_links)
        assert got[k]["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")


# ------------------------------------------------------------------ quality from positives and unlabelled text


def good(r):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(r.randint(30, 90))).capitalize() + "."


def bad(r):
    return " ".join(r.choice(["buy!!", "### now $$$", "CLICK", "|", "| x |", "word word word"]) for _ in range(r.randint(30, 90)))


@pytest.fixture(scope="module")
def pu_tables(spark):
    r = random.Random(31)
    truth = [int(r.random() < 0.7) for _ in range(1500)]
    docs = [(k, good(r) if y else bad(r), "x", 0.25) for k, y in enumerate(truth)]
    docs += [(1500, None, "x", 0.5), (1501, "", "x", 0.5), (1502, "word " * 60_000, None, None), (None, docs[0][1], "x", 0.5), (0, docs[0][1], "x", 0.5)]
    labels = [(k, y, 0) for k, y in enumerate(truth) if k % 2] + [(None, 1, 0), (5, None, 0), (7, 1 - truth[7], 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, id string, score double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), truth


def test_pu_quality(spark, pu_tables):
    docs, labels, truth = pu_tables
    got = pu_quality.score(docs, labels).collect()
    assert len(got) == len(truth) + 5 and all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.5) for g in got)
    by_id = {g["doc_id"]: g["predicted"] for g in got}
    assert np.mean([by_id[k] == truth[k] for k in range(0, 1500, 2)]) > 0.95  # ids that no label was read for
    alone = pu_quality.score(docs.drop("id", "score"), labels.where("quality = 1 or doc_id = 7")).collect()
    assert sorted(map(tuple, alone), key=repr) == sorted(map(tuple, got), key=repr), "negative labels and other columns change nothing"


def test_pu_quality_prior_and_risk():
    r = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85):
        p, n = r.normal(1.5, 1, (3000, 4)), r.normal(-1.5, 1, (3000, 4))
        u = np.vstack([p[: int(2000 * share)] + r.normal(0, 0.01, (int(2000 * share), 4)), n[: 2000 - int(2000 * share)]])
        model = pu_quality.fit(p[2000:].astype(np.float32), u.astype(np.float32))
        assert abs(model.prior - share) < 0.07
        hit = np.r_[model.scores(p[2000:].astype(np.float32)) >= 0.5, model.scores(n[2000:].astype(np.float32)) < 0.5]
        assert hit.mean() > 0.95


def test_pu_quality_of_nothing(spark, pu_tables):
    docs, labels, _ = pu_tables
    assert pu_quality.score(docs.limit(0), labels).count() == 0
    assert {(r["score"], r["predicted"]) for r in pu_quality.score(docs, labels.where("quality = 0")).collect()} == {(0.0, 0)}


def test_pu_quality_query_learns_from_learnable_rows_only(spark, tmp_path):
    from tessera.llm import queries

    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = queries.op12_pu_quality(spark, folder).toPandas().set_index("doc_id")
    held = [k for k in got.index if zlib.crc32(str(k).encode()) % 3 == 1]
    assert got.loc[held, "held_out"].all() and got["held_out"].sum() == len(held)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect() if r["doc_id"] in set(held)}
    assert np.mean([got.loc[k, "predicted"] == y for k, y in truth.items()]) > 0.93
    # labels of held-out rows, turned round, change no score
    turned = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1 then 1 - quality else quality end as quality", "toxic")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    turned.write.parquet(f"{tmp_path}/labels.parquet")
    again = queries.op12_pu_quality(spark, str(tmp_path)).toPandas().set_index("doc_id").loc[got.index]
    assert np.allclose(again["score"], got["score"])


# ------------------------------------------------------------------ whitening


def plain_whitening(vectors, most=16):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, s = len(fit), fit.sum(axis=0)
    far = [sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    c = (fit * n - s).astype(float) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:most], v[:, ::-1][:, :most]
    return n, far, ((x * n - s).astype(float) / n) @ v, e, np.trace(c.T @ c / n)


def test_whitening_equals_plain_version(spark):
    r = np.random.default_rng(8)
    base = r.normal(0, 1, (300, 20)) @ r.normal(0, 1, (20, 20))
    rows = [(k, [float(np.float32(c)) for c in v], 1.0, "x") for k, v in enumerate(base)]
    rows += [(1000 + k, rows[7][1], 2.0, "x") for k in range(150)] + [(2000, None, 1.0, "x"), (2001, [1.0] * 19 + [None], 1.0, "x"), (2002, [float("nan")] + [0.0] * 19, 1.0, None), (2003, [float("inf")] * 20, 1.0, "x"), (None, rows[3][1], None, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n double, x string").repartition(5)
    got = whitening.whiten(table).toPandas()
    kept = [(i, v) for i, v, *_ in rows if i is None or i < 2000]
    n, far, projected, e, trace = plain_whitening([v for _, v in kept])
    assert len(got) == 16 * len(kept) and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    assert sorted(map(int, got[got["component"] == 1]["deviation"])) == sorted(far)
    sign = {}
    for k, (i, _) in enumerate(kept):
        if i is None:
            continue
        own = got[got["vec_id"] == i].sort_values("component")
        assert int(own["deviation"].iloc[0]) == far[k]
        white = own["whitened"].to_numpy()
        for c in range(16):
            want = projected[k, c] / np.sqrt(e[c])
            sign.setdefault(c, np.sign(white[c] * want))
            assert abs(white[c] - sign[c] * want) < 1e-7
        assert np.allclose(own["explained"], e / trace, rtol=1e-9)


def test_whitening_of_few_dimensions_and_of_nothing(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.whiten(make([])).count() == 0 and whitening.whiten(make([(1, None), (2, [])])).count() == 0
    one = whitening.whiten(make([(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert len(one) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    flat = whitening.whiten(make([(k, [float(k), 2.0 * k, 5.0]) for k in range(8)])).orderBy("vec_id", "component").collect()
    assert [r["component"] for r in flat[:3]] == [1, 2, 3] and flat[0]["whitened"] is not None and flat[1]["whitened"] is None
    assert abs(flat[0]["explained"] - 1) < 1e-9 and flat[0]["identity_error"] < 1e-9
    with pytest.raises(ValueError, match="one length"):
        whitening.whiten(make([(1, [1.0]), (2, [1.0, 2.0])]))


def test_chan_merging_in_any_order():
    r = np.random.default_rng(1)
    x = r.normal(1e6, 3, (1000, 5))
    parts = [whitening.moments(x[a : a + 90]) for a in range(0, 1000, 90)] + [(0, np.zeros(5), np.zeros((5, 5)))]
    random.Random(2).shuffle(parts)
    while len(parts) > 1:
        parts = [whitening.merged(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    n, mean, scatter = parts[0]
    assert n == 1000 and np.allclose(mean, x.mean(axis=0)) and np.allclose(scatter / n, np.cov(x.T, bias=True))


def test_deviations_beyond_long_are_exact():
    model = whitening.Whitening(10**9, (10**15 + 3, 7), np.eye(2), np.ones(2), 2.0)
    x = np.array([[1_000_050, 0], [999_000, -5]])
    assert model.deviations(x) == [sum((10**9 * a - s) ** 2 for a, s in zip(r, model.sums, strict=True)) for r in x.tolist()]
