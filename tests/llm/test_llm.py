"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows, extra columns."""

import base64
import collections
import hashlib
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, decontam, langid, licenses, line_dedup, ngram_join, packing, pii, quality, queries, toxicity, warc
from tessera.llm.queries import tokenizer_path

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
rnd = random.Random(5)
VOCABULARY = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def table(spark, texts, **extra):
    rows = [(k, t, "x", 1.5) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n double").repartition(3)


def edited(text, k, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = r.choice(VOCABULARY) + "q"
    return " ".join(w)


# ------------------------------------------------------------------ 1


def base_brute(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), pii.KINDS.index(kind), m.end()))
    return sorted(out)


def test_pii_patterns_equal_plain_regexes():
    r = random.Random(3)
    pieces = ["a.b@c.de", "@", "a@b", "x@y.z@w.v.u", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (301) 555-0346", "+12", "é", "\n", " ", "00.0.0.01", "+1.2.3.4.5.6.7.8.9", "...@a-b.c", "12 34"]
    for k in range(400):
        text = "".join(r.choice(pieces) + r.choice(["", " ", "-"]) for _ in range(r.randint(0, 12)))
        assert [(a, kind, b) for a, b, kind in pii.base_spans(text)] == base_brute(text), text


def test_pii(spark):
    secret = "0f" * 20
    texts = [None, "", "call +1 (301) 555-0346 or a.b@mail.example.com", f'stor in token = "{secret}" thea of.', prose(300, 1), "the token of the key", "x" * 50_000, f'stor in token = "{secret}" thea of.']
    got = {r["doc_id"]: r for r in pii.find_pii(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert [s["kind"] for s in got[2]["base"]] == ["phone", "email"]
    for k in (3, 7):
        a = texts[3].index(secret)
        assert [(s["kind"], s["start"], s["end"]) for s in got[k]["added"]] == [("secret", a, a + 40)]
    for k in (0, 1, 4, 5, 6):
        assert not got[k]["base"] and not got[k]["added"]
    assert pii.find_pii(table(spark, [])).count() == 0


def test_hashes_and_uuids_are_no_secrets():
    tagger = pii.Tagger(pii.trained().emit, pii.trained().trans)
    r = random.Random(44)
    hexed = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    plain = [f"commit {hexed(40)}", f"stor the checksum {hexed(64)} of", f"md5 {hexed(32)} thea", f"in the {hexed(40)} of", "uuid 123e4567-e89b-12d3-a456-426614174000 thea", "anon the key of token thea"]
    secret = [f'token = "{hexed(40)}"', f'stor in token = "{hexed(40)}" thea of.', f"api_key={hexed(32)}"]
    hits = {k for k, _ in tagger.secret_words([t.split() for t in plain + secret])}
    assert hits == set(range(len(plain), len(plain) + len(secret)))


def test_a_secret_stays_beside_a_card_within_it(spark):
    secret = "ab" + "4111111111111111" + "cdefabcdefabcdefabcdef"
    text = f'token = "{secret}"'
    (row,) = pii.find_pii(table(spark, [text])).collect()
    assert [s["kind"] for s in row["base"]] == ["card"]
    assert [(s["start"], s["end"]) for s in row["added"]] == [(text.index(secret), text.index(secret) + len(secret))]


def test_op1_query_digests(spark, tmp_path):
    texts = [None, "", "a.b@mail.example.com and +1 (301) 555-0346 at 10.0.0.1", "4111 1111 1111 1111", 'token = "' + "0f" * 20 + '"']
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op1_pii(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        spans = base_brute(t or "")
        digest = ",".join(f"{pii.KINDS[kind]}:{a}:{b}" for a, kind, b in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest()
        assert [got[k]["n_" + kind] for kind in pii.KINDS[:4]] == [sum(kind == pii.KINDS[x] for _, x, _ in spans) for kind in pii.KINDS[:4]]
    assert got[4]["spans"] == "secret:9:49" and got[3]["spans"] == "card:0:19"


def test_op8_query_holds_out_by_crc(spark, tmp_path):
    texts = [prose(30, k) for k in range(30)] + [None, "12"]
    table(spark, texts).withColumn("lang", F.lit("en")).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op8_language(spark, str(tmp_path)).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k in range(len(texts)))
    assert got[30]["lang_pred"] == got[31]["lang_pred"] == "und" and got[0]["lang_pred"] == "en"


def test_op2_query_digests(spark, tmp_path):
    texts = ["a line of words\nb", "a line of words\nother", None]
    table(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in queries.op2_line_dedup(spark, str(tmp_path)).collect()}
    assert [got[k]["n_removed"] for k in range(3)] == [0, 1, 0] and got[1]["text_sha256"] == hashlib.sha256(b"other").hexdigest() and got[2]["text_sha256"] is None


def test_crf_viterbi_is_the_best_path():
    crf = pii.trained()
    lines = [w for w, _ in pii.labelled_lines(1)][:40]
    tagger = pii.Tagger(crf.emit, crf.trans)
    hits = set(tagger.secret_words([*lines, []]))
    for k, words in enumerate(lines):
        e = crf.scores([pii.features(w) for w in words])
        best, back = e[0], []
        for t in range(1, len(words)):
            both = best[:, None] + crf.trans
            back.append(both.argmax(axis=0))
            best = both.max(axis=0) + e[t]
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        for t, y in enumerate(reversed(path)):
            assert ((k, t) in hits) == (y == pii.LABELS.index("SECRET"))


def test_crf_on_unseen_lines():
    right = total = 0
    tagger = pii.Tagger(pii.trained().emit, pii.trained().trans)
    for words, labels in pii.labelled_lines(3, seed=99):
        hit = {w for _, w in tagger.secret_words([words])}
        total += len(words)
        right += sum((t in hit) == (y == pii.LABELS.index("SECRET")) for t, y in enumerate(labels))
    assert right / total > 0.99


# ------------------------------------------------------------------ 2


def lines_brute(texts, radius, similarity):
    def sim(ws):
        ws = list(dict.fromkeys(ws))
        b = np.array([[xxhash.xxh64_intdigest(w.encode(), 42) >> j & 1 for j in range(64)] for w in ws]).sum(0)
        return sum(1 << j for j in range(64) if 2 * b[j] > len(ws))

    def apart(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    occurrences, names = [], {}
    for doc, text in sorted(texts.items()):
        for pos, line in enumerate((text or "").split("\n")):
            if ws := WORD.findall(line.lower()):
                occurrences.append((doc, pos, names.setdefault(" ".join(ws), (len(names), sim(ws)))[0]))
    group = list(range(len(names)))
    listed = [(n, s) for n, (_, s) in names.items()]
    for a in range(len(listed)):
        for b in range(a):
            (x, s), (y, t) = listed[a], listed[b]
            if bin(s ^ t).count("1") <= radius and min(len(x), len(y)) >= similarity * max(len(x), len(y)) and apart(x, y) <= int(max(len(x), len(y)) * (1 - similarity) + 1e-9):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    kept, out = {}, {}
    for doc, pos, k in occurrences:
        kept.setdefault(group[k], (doc, pos))
    for doc, text in texts.items():
        gone = {p for d, p, k in occurrences if d == doc and kept[group[k]] != (d, p)}
        out[doc] = None if text is None else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in gone)
    return out


def test_line_dedup(spark):
    shared, base = prose(12, 1), prose(40, 2)
    texts = [None, "", shared + "\n" + prose(20, 3), "Head\n" + shared.upper() + "\n\nx", base, base + "s", prose(9, 4) + "\n" + base[:-1] + "z", shared, "a | b | c\nd | e | f", "  \n\t", "y\n" * 30]
    texts += [prose(60, 7) if k % 2 else edited(prose(60, 7), 1, k) for k in range(8)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(table(spark, texts), radius=3).collect()}
    want = lines_brute(dict(enumerate(texts)), 3, 0.9)
    assert {k: r["text"] for k, r in got.items()} == want
    assert got[3]["n_lines"] == 3 and got[7]["n_removed"] == 1
    assert line_dedup.dedup(table(spark, []), radius=3).count() == line_dedup.dedup(table(spark, [])).count() == 0
    assert line_dedup.dedup(table(spark, texts), radius=3).columns == ["doc_id", "text", "id", "n", "n_lines", "n_removed"]


def typed(text, k, seed):
    r, w = random.Random(seed), list(text)
    for at in r.sample(range(len(w)), k):
        w[at] = "#"
    return "".join(w)


def test_line_dedup_finds_edited_lines_of_any_length(spark):
    base = [prose(n, 500 + n) for n in (6, 12, 20, 50)]
    texts = base + [c for t in base for c in (typed(t, max(1, len(t) // 30), 2), "q" + t)] + [edited(base[3], 2, 3)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(table(spark, texts), radius=None).collect()}
    assert [got[k] for k in range(4)] == base and all(got[k] == "" for k in range(4, len(texts)))


def test_line_dedup_recall_against_edit_similarity(spark):
    """No SimHash or sketch here: of all pairs of lines with an edit similarity of 0.9 or more, those in one group."""
    r = random.Random(12)
    base = [prose(r.choice([4, 8, 15, 30, 60]), 700 + k) for k in range(60)]
    lines = [t for t in base if len(t) >= 10]
    for k, t in enumerate(base):
        w = t.split()
        for _ in range(2):
            x = list(w)
            for _ in range(max(1, len(w) // 16)):  # a word replaced, put in or left out; else a letter is
                at = r.randrange(len(x))
                x[at : at + 1] = r.choice(([r.choice(VOCABULARY)], [x[at], r.choice(VOCABULARY)], []))
            lines.append(" ".join(x) if len(t) > 80 and x else typed(t, 1, k))
    lines = sorted(set(lines))
    texts = {k: t for k, t in enumerate(lines)}

    def similar(a, b):
        most = int(max(len(a), len(b)) * 0.1 + 1e-9)
        if abs(len(a) - len(b)) > most:
            return False
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            if min(new) > most:
                return False
            row = new
        return row[-1] <= most

    pairs = [(a, b) for a in texts for b in range(a) if similar(texts[a], texts[b])]
    docs = table(spark, list(texts.values()))
    raw = line_dedup._normal_lines(docs, "doc_id", "text").withColumns({"k": F.xxhash64("line"), "chars": F.length("line")})
    raw = line_dedup.with_sketch(raw)
    nodes = raw.select("k", "chars", F.struct("id", "th", "pos").alias("at"), *line_dedup._SKETCH, *line_dedup._RARE)
    name = {x["id"]: x["k"] for x in raw.select("id", "k").collect()}
    found = line_dedup.links(nodes, docs, None, 0.9, "doc_id", "text")
    group = {x["node"]: x["component"] for x in components.components(found).collect()}
    of = lambda k: group.get(name[k], name[k])
    caught = sum(of(a) == of(b) for a, b in pairs)
    assert len(pairs) > 60 and caught >= 0.95 * len(pairs), (caught, len(pairs))
    back = {v: k for k, v in name.items()}
    assert all(similar(texts[back[x["a"]]], texts[back[x["b"]]]) for x in found.collect())


@pytest.mark.parametrize("words", [6, 30, 80])
def test_line_dedup_finds_scattered_edits(spark, words):
    """Characters put in, left out and replaced anywhere, and words replaced, of up to a tenth of a line's characters."""
    r = random.Random(words)
    names = ["".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.choice([2, 3, 3, 4, 5, 5, 6, 7, 8, 9]))) for _ in range(3000)]
    texts, shares = [], []
    for share in (0.05, 0.08, 0.1):
        for k in range(120):
            t = " ".join(r.choice(names) for _ in range(words))
            many = int(len(t) * share + 1e-9)
            if k % 3 < 2:
                w = list(t)
                for at in sorted(r.sample(range(len(w)), many), reverse=True):
                    w[at : at + 1] = [r.choice("0123456789")] if k % 3 == 0 else r.choice(([], [w[at], r.choice("0123456789")]))
                other = " ".join("".join(w).split())
            else:
                w = t.split()
                for at in r.sample(range(len(w)), len(w)):
                    if len(w[at]) <= many:
                        many, w[at] = many - len(w[at]), "#" * len(w[at])
                other = " ".join(w)
            texts += [t, other]
            shares.append(share)
    gone = {x["doc_id"] for x in line_dedup.dedup(table(spark, texts)).where("n_removed > 0").collect()}
    assert all(k % 2 for k in gone)
    for share in (0.05, 0.08, 0.1):
        of = [2 * k + 1 for k, s in enumerate(shares) if s == share]
        assert len(gone & set(of)) >= 0.9 * len(of), (share, len(gone & set(of)), len(of))


def test_line_dedup_finds_edited_lines_among_many_that_hold_one_passage(spark):
    passage = prose(30, 900)
    texts = [f"{prose(25, 2000 + k)} {passage} {prose(20, 3000 + k)}" for k in range(90)]
    near = [typed(t, len(t) // 20, k) for k, t in enumerate(texts[:40])]
    gone = {x["doc_id"] for x in line_dedup.dedup(table(spark, texts + near)).where("n_removed > 0").collect()}
    assert gone <= set(range(90, 130)) and len(gone) >= 36, len(gone)


def test_line_dedup_finds_edited_lines_whose_features_are_all_common(spark):
    """Lines of nine passages, each one of two, that differ in two at least: more than 60 lines hold each of a line's features."""
    r = random.Random(31)
    pick = [k for k in range(512) if k.bit_count() % 2 == 0]
    passage = [[" ".join("".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 6))) for _ in range(5)) for _ in range(2)] for _ in range(9)]
    texts = [" ".join(passage[i][k >> i & 1] for i in range(9)) for k in pick]
    near = [typed(texts[4 * k], len(texts[4 * k]) * 8 // 100, k) for k in range(60)]
    gone = {x["doc_id"] for x in line_dedup.dedup(table(spark, texts + near)).where("n_removed > 0").collect()}
    assert gone <= set(range(256, 316)) and len(gone) >= 54, len(gone)


def test_long_lines_have_the_same_simhash(spark, monkeypatch):
    docs = table(spark, [prose(900, k) for k in range(3)] + [prose(20, 9)])
    whole = {r["k"]: r["sim"] for r in line_dedup.line_table(docs, "doc_id", "text").collect()}
    monkeypatch.setattr(line_dedup, "_CHARS", 1000)
    monkeypatch.setattr(line_dedup, "_WORDS", 100)
    assert {r["k"]: r["sim"] for r in line_dedup.line_table(docs, "doc_id", "text").collect()} == whole


def test_masks_miss_no_pair():
    r = random.Random(1)
    for lines in (10, 10**6, 10**9, 10**12):
        keys = line_dedup.masks(lines, 3)
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for j in r.sample(range(64), 3):
                b ^= 1 << j
            assert any(a & m % (1 << 64) == b & m % (1 << 64) for m in keys)


# ------------------------------------------------------------------ 3


def classes_brute(texts, num=75, den=100):
    sets = {}
    for k, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[k] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    group = {k: k for k in texts}
    for a in texts:
        for b in texts:
            x, y = sets[a], sets[b]
            if a < b and x and y and den * len(x & y) >= num * len(x | y):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if g == old else g for k, g in group.items()}
    return {k: (len(sets[k]), group[k]) for k in texts}


@pytest.mark.parametrize("longest", [128, 3])
def test_ngram_classes(spark, longest):
    base, passage = prose(120, 1), prose(60, 2)
    texts = [None, "", "one two", "One  two", "a b c d e", base, base.upper(), prose(3000, 5), prose(3000, 5) + " end", " \t\n"]
    texts += [edited(base, k % 5, k) for k in range(40)] + [passage + " " + prose(15 + k % 7, 100 + k) for k in range(40)] + [edited(prose(30, 50 + k // 2), k % 2, k) for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(table(spark, texts), longest=longest, postings_a_block=50).collect()}
    assert got == classes_brute(dict(enumerate(texts)))


def test_ngram_empty(spark):
    assert ngram_join.classes(table(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)]
    group = {k: k for k in range(700)}
    for a, b in edges:
        old, new = max(group[a], group[b]), min(group[a], group[b])
        group = {k: new if g == old else g for k, g in group.items()}
    got = {x["node"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: g for k, g in group.items() if k != g}


# ------------------------------------------------------------------ 4


def test_toxicity(spark):
    r = random.Random(8)
    texts, labels = [], []
    for k in range(600):
        bad = k % 5 == 0
        texts.append(prose(r.randint(20, 80), k) + (" " + " ".join(r.sample(["idiot", "moron", "trash", "pathetic", "zuffel"], 2)) if bad else ""))
        labels.append((k, int(bad)))
    texts += [None, "", prose(20000, 9), prose(20000, 9) + " you moron and trash"]
    known = spark.createDataFrame([x for x in labels if x[0] % 3], "doc_id long, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(table(spark, texts), known).collect()}
    held = [k for k, _ in labels if k % 3 == 0]
    assert np.mean([got[k]["toxic"] == bool(dict(labels)[k]) for k in held]) > 0.97
    assert not got[600]["toxic"] and not got[601]["toxic"] and not got[602]["toxic"] and got[603]["toxic"]
    none = toxicity.score(table(spark, ["a", None]), known.limit(0)).collect()
    assert [x["toxic"] for x in none] == [False, False]
    assert toxicity.score(table(spark, []), known).count() == 0


# ------------------------------------------------------------------ 5


def test_tokens_equal_tokenizers():
    from tokenizers import Tokenizer

    fast, exact = packing.tokens_of(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    r = random.Random(4)
    alphabet = "abc DEF  \n\t.,'’é漢字🙂0123<|> \x00"
    texts = ["", "it's WE'LL", "<|endoftext|> a", "a" * 3000, *["".join(r.choice(alphabet) for _ in range(r.randint(1, 80))) for _ in range(500)]]
    for t in texts:
        assert fast.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_tokens_of_very_long_runs_equal_tokenizers():
    from tokenizers import Tokenizer

    fast, exact = packing.tokens_of(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    for t in (" " * 2_000_000, "\n" * 2_000_000, "a" + " " * 1_000_000 + "b", "ab" * 500_000):
        assert fast.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_packing_of_a_very_long_blank_text(spark):
    rows = packing.pack(table(spark, ["x" + " " * 1_500_000, "y"]), tokenizer_path()).collect()
    assert {x["doc_id"] for x in rows} == {0, 1} and max(x["length"] for x in rows) <= 2048


def test_packing(spark):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_path())
    texts = [None, "", *[prose(rnd.randint(1, 60), k) for k in range(150)], prose(900, 1), prose(900, 1)]
    rows = packing.pack(table(spark, texts), tokenizer_path(), capacity=64, least_blocks=3).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        by_doc[x["doc_id"]].append(x)
        by_sequence[x["sequence_id"]].append(x)
    for k, t in enumerate(texts):
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        own = sorted(by_doc[k], key=lambda x: x["piece"])
        assert [x["piece"] for x in own] == list(range(len(own))) and sum(x["length"] for x in own) == len(ids)
        assert all(x["length"] == 64 for x in own[1:])
        at = 0
        for x in own:
            assert x["start"] == at and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
    for own in by_sequence.values():
        at = 0
        for x in sorted(own, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= 64
    least = -(-sum(x["length"] for x in rows) // 64)
    assert len(by_sequence) <= least * 1.03 + 1
    assert packing.pack(table(spark, []), tokenizer_path()).count() == 0


def test_plans_place_every_piece_once():
    r = random.Random(6)
    for trial in range(30):
        capacity = r.choice([16, 64, 500])
        counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 30))}
        for d, groups in ((2, 4), (3, 8), (8, 3)):
            rows, used = packing.plan(counts, capacity, capacity // d, groups)
            seen, fill = collections.defaultdict(list), collections.defaultdict(list)
            for n, a, b, s, o in rows.tolist():
                seen[n] += range(a, b)
                for k in range(b - a):
                    fill[s + k].append((o, n))
            assert {n: sorted(v) for n, v in seen.items()} == {n: list(range(c)) for n, c in counts.items()}
            assert len(fill) == used
            for parts in fill.values():
                at = 0
                for o, n in sorted(parts):
                    assert o == at
                    at += n
                assert at <= capacity


# ------------------------------------------------------------------ 6


def contaminated_brute(texts, items, threshold=0.75):
    words = {k: WORD.findall((t or "").translate(LOWER)) for k, t in texts.items()}
    own = {i: WORD.findall(t.translate(LOWER)) for i, t in items.items()}
    bag = lambda w: collections.Counter([tuple(w[j : j + 5]) for j in range(len(w) - 4)] or [tuple(w)])
    df = collections.Counter(g for w in own.values() if w for g in bag(w))
    n = sum(bool(w) for w in own.values())
    weight = lambda g: np.log1p(n / df[g]) if g in df else np.log1p(n)
    out = {}
    for k, w in words.items():
        for i, v in own.items():
            if not w or not v:
                continue
            b, best = bag(v), 0.0
            for p in range(max(len(w) - len(v), 0) + 1):
                a = bag(w[p : p + len(v)])
                if a.keys() & b.keys():
                    best = max(best, sum(min(a[g], b[g]) * weight(g) for g in a) / sum(max(a[g], b[g]) * weight(g) for g in a | b))
            if best >= threshold - 1e-9:
                out[k, i] = round(best, 9)
    return out


def test_decontamination(spark):
    items = {k: prose(n, 1000 + k) for k, n in enumerate([3, 7, 12, 25, 40, 41, 60, 300])} | {8: prose(40, 1004), 9: ""}
    texts = [None, "", items[0], prose(500, 1), "x " * 4000]
    texts += [prose(n, 7) + " " + items[k].upper() + " " + prose(m, 8) for k in range(1, 8) for n, m in ((0, 30), (33, 0), (101, 57))]
    texts += [prose(50, k) + " " + edited(items[6], 1, k) + " " + prose(9, k) for k in range(6)]
    bench = spark.createDataFrame([*items.items(), (10, None), (None, "a b c")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in decontam.contaminated(table(spark, texts), bench).collect()}
    want = contaminated_brute(dict(enumerate(texts)), items)
    assert got == want
    # weights are counted over all items, so passes change nothing
    passes = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table(spark, texts), bench, items_a_pass=4).collect()}
    assert set(want) == passes
    assert decontam.contaminated(table(spark, []), bench).count() == 0 and decontam.contaminated(table(spark, texts), bench.limit(0)).count() == 0


def test_blocks_guarantee_the_radius():
    r = np.random.default_rng(1)
    for _ in range(50):
        v = r.integers(0, 1 << 63, dtype=np.uint64)
        flags = [decontam.near_flags(np.array([v >> np.uint64(16 * b)]).astype(np.uint16), 11 // 4) for b in range(4)]
        for _ in range(50):
            x = v
            for j in r.choice(64, 11, replace=False):
                x ^= np.uint64(1) << np.uint64(j)
            assert any(flags[b][int(x >> np.uint64(16 * b)) & 0xFFFF] for b in range(4))


# ------------------------------------------------------------------ 7


def test_licenses(spark):
    full = licenses.TEMPLATES["MIT"][2]
    texts = [None, "", prose(100, 1), "x\nLicensed under the Apache License, Version 2.0.", prose(50, 2) + " " + full + " " + prose(50, 3), full.replace("free of charge", "without any charge").replace(". ", ".\n"), "This work is licensed under the GNU General Public License, version 2.", "This work is licensed under the GNU General Public License, version 3.", "the license of the permission", "licence " * 3000]
    got = collections.defaultdict(list)
    for r in licenses.scan(table(spark, texts)).collect():
        got[r["doc_id"]].append((r["license"], r["n_edits"]))
    assert got == {3: [("Apache-2.0", 0)], 4: [("MIT", 0)], 5: [("MIT", 2)], 6: [("GPL-2.0", 0)], 7: [("GPL-3.0", 0)]}
    assert licenses.scan(table(spark, [])).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", "// ", " * "])
def test_wrapped_notices(mark):
    scanner, CUES = licenses.Scanner(licenses.TEMPLATES, 9, 6, 0.1, 0.2), licenses.Cues(licenses.TEMPLATES, 0.1)  # noqa: N806
    for name, notices in licenses.TEMPLATES.items():
        for notice in notices:
            text = "import os\n" + "\n".join(mark + x for x in textwrap.wrap(notice, 72, break_on_hyphens=False)) + "\n\nx = 1\n"
            found = [scanner.match(text[a:b]) for a, b in licenses.blocks(text, CUES)]
            assert len(found) == 1 and found[0] and (found[0][0] if isinstance(found[0], tuple) else found[0][0][0]) == name, (notice, found)


def test_every_notice_of_a_block_is_found(spark):
    texts = ["Licensed under the MIT License.\nLicensed under the Apache License, Version 2.0.", "Released under the MIT License. All rights reserved.", licenses.TEMPLATES["Apache-2.0"][1] + "\n" + licenses.TEMPLATES["ISC"][0]]
    got = collections.defaultdict(list)
    for r in licenses.scan(table(spark, texts)).collect():
        got[r["doc_id"]].append(r["license"])
    assert {k: sorted(v) for k, v in got.items()} == {0: ["Apache-2.0", "MIT"], 1: ["MIT", "Proprietary"], 2: ["Apache-2.0", "ISC"]}
    scanner = licenses.Scanner(licenses.TEMPLATES, 9, 6, 0.1, 0.2)
    assert [m[0] for m in scanner.match("All rights reserved.\n" * 300)] == ["Proprietary"] * 300


def test_wording_is_the_least_number_of_edits():
    r = random.Random(1)
    for _ in range(200):
        a, b = [[r.choice("abc") for _ in range(r.randint(0, 7))] for _ in range(2)]
        rows = [[0] * (len(b) + 1)]
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y)))
            rows.append(row)
        edits, start, end = licenses.wording(a, b)
        assert edits == min(rows[-1]) and 0 <= start <= end <= len(b)


# ------------------------------------------------------------------ 8


def test_language(spark):
    parts = {"en": "the of and ing tion er hat with", "de": "der und sch ung ein keit ich ß", "fr": "le de que eau é tion ou è", "es": "el los que ción ado ñ ar de"}
    rows = []
    for k in range(800):
        lang = list(parts)[k % 4]
        r = random.Random(k)
        rows.append((k, " ".join("".join(r.choice(parts[lang].split()) for _ in range(r.randint(1, 3))) for _ in range(r.randint(8, 60))), lang))
    rows += [(800, None, "en"), (801, "", "en"), (802, "123 !! ...", "en"), (803, "the " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("id", F.lit("x"))
    got = {r["doc_id"]: r for r in langid.identify(docs, F.col("id") % 3 != 1, per_lang=100).collect()}
    assert len(got) == 804
    assert np.mean([got[k]["lang_pred"] == lang for k, _, lang in rows[:800] if k % 3 == 1]) > 0.97
    assert [got[k]["lang_pred"] for k in (800, 801, 802)] == ["und"] * 3 and got[803]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(docs.limit(5), F.lit(False)).collect()
    assert {r["lang_pred"] for r in none} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


# ------------------------------------------------------------------ 9


def test_more_languages_than_allowed_are_an_error(spark):
    docs = table(spark, [prose(20, k) for k in range(6)]).withColumn("lang", F.concat(F.lit("l"), "doc_id"))
    with pytest.raises(ValueError, match="most_langs"):
        langid.identify(docs, most_langs=5)


def test_warc_round_trip(spark):
    htmls = [None, "", "<p>é</p>\r\n\r\n" * 3, "<p>é</p>\r\n\r\n" * 3, prose(4000, 1), "WARC/1.1\r\n\r\n", *[f"<html>{prose(80, k)}</html>" for k in range(40)], prose(4000, 1)]
    rows = [(k + 10, None if k == 4 else f"http://x/{k}", h, "z") for k, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, size string").repartition(3)
    manifest = warc.write(pages, dict_bytes=512, roll_bytes=2_000)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = {r["page_id"]: r for r in warc.read(manifest).collect()}
    first = {}
    for k, _, h, _ in rows:
        first.setdefault(h or "", k)
    for k, url, h, _ in rows:
        body = (h or "").encode()
        r = got[k]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        own = first[h or ""] == k
        assert (r["record_type"], r["refers_to"]) == (("response", None) if own else ("revisit", first[h or ""]))
        assert r["url"] == (url or f"urn:page:{k}") and (not own or r["html"] == (h or ""))
    path = re.sub("^file:/+", "/", manifest.first()["file"])
    with open(path, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.SKIPPABLE
    assert warc.archives(spark, pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, "same"), (5, "u", "same"), (5, "u", "same"), (7, "u v", "same")], "page_id long, url string, html string")
    assert sorted(((r["page_id"] or -1), r["record_type"], r["refers_to"]) for r in warc.archives(spark, odd).collect()) == [(-1, "response", None), (5, "response", None), (5, "response", None), (7, "revisit", 5)]


def test_warc_notices_damage(spark):
    pages = spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string")
    good = warc.record(1, "u", b"abc", None, "2024-01-01T00:00:00Z")

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:n], self.data[n:]
            return out

    assert len(list(warc.records_in(Stream(good * 3)))) == 3
    for bad in (good[:-9], good[:30], b"nonsense\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.records_in(Stream(bad)))
    assert pages.count() == 1


# ------------------------------------------------------------------ 10


def statistics_brute(text):
    w = WORD.findall(text or "")
    n = len(w)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(n - 4))
    cover = {i + j for i in range(n - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover)


def test_quality(spark):
    r = random.Random(1)
    texts, labels = [None, "", "one", "a b c d e " * 20, "x\n\n x\nx\n", "é# ñ% " * 9, prose(20000, 3) + " " + prose(40, 3)], []
    for k in range(400):
        bad = k % 4 == 0
        labels.append((len(texts), 0 if bad else 1))
        texts.append(" ".join(w + "###" for w in prose(30, k).split()) if bad else prose(r.randint(15, 200), k))
    out = quality.judge(table(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {x["doc_id"]: x for x in out.collect()}
    for k, t in enumerate(texts):
        s = statistics_brute(t)
        assert tuple(got[k][c] for c in quality.STATISTICS) == s
        assert got[k]["base_failed"] == (s[0] < 10 or 100 * s[4] > 20 * s[0])
    assert all(got[k]["kept"] == bool(q) for k, q in labels)
    assert not any(got[k]["kept"] for k in range(5))
    assert out.where("kept").count() == sum(x["kept"] for x in got.values())
    none = quality.judge(table(spark, texts), spark.createDataFrame([], "doc_id long, quality int"))
    assert {x["rule"] for x in none.collect()} == {0}
    assert quality.judge(table(spark, []), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0


def test_repeated_windows_of_long_texts(spark):
    base = prose(30_000, 21).split()
    texts = [" ".join(base + base[1000:1010] + prose(3000, 22).split() + base[:2000]), "a " * 100_000, prose(50_000, 23)]
    got = {x["doc_id"]: x for x in quality.with_statistics(table(spark, texts)).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in quality.STATISTICS) == statistics_brute(t)


def test_rules_are_a_list_of_conditions():
    rng = np.random.default_rng(1)
    x = rng.random((800, 3))
    bad = (x[:, 0] > 0.8) | ((x[:, 1] < 0.3) & (x[:, 2] > 0.6))
    rules = quality.learn_rules(x, bad, ["a", "b", "c"])
    hit = np.zeros(800, bool)
    for rule in rules:
        hit |= quality._covers(rule, x, ["a", "b", "c"])
    assert (hit == bad).mean() > 0.97 and quality.learn_rules(x, np.zeros(800, bool), ["a", "b", "c"]) == []


def test_documents_without_an_id_crash_nothing(spark):
    text = prose(60, 1)
    docs = spark.createDataFrame([(None, text), (None, text), (1, text), (2, None), (2, text), (2, text)], "doc_id long, text string")
    bench, toxic = spark.createDataFrame([(1, text)], "item_id long, text string"), spark.createDataFrame([(1, 0, 1), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    assert pii.find_pii(docs).count() == line_dedup.dedup(docs).count() == ngram_join.classes(docs).count() == toxicity.score(docs, toxic).count() == quality.judge(docs, toxic).count() == 6 + 0 * licenses.scan(docs).count()
    assert packing.pack(docs, tokenizer_path()).count() == 6 and decontam.contaminated(docs, bench).count() == 5
    assert langid.identify(docs.withColumn("lang", F.lit("en"))).count() == 6


# ------------------------------------------------------------------ pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    item = prose(40, 77)
    base = prose(80, 1)
    texts = [base, edited(base, 1, 3), prose(60, 2) + " " + item, "### " * 50, "one two", None, prose(90, 3), prose(90, 4) + "\nshared line of words here", prose(90, 5) + "\nshared line of words here"]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = c.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} == {0, 6, 7, 8}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r["doc_id"]: r for r in c.repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert kept[8]["text"] == prose(90, 5) and kept[8]["n_chars"] == len(prose(90, 5)) and kept[7]["text"] == texts[7]


def pipeline_tables(spark, folder, texts, items, ids=None):
    rows = [(k if ids is None else ids[k], t, "en", "s", len(t or ""), 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __k int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline as c

    pipeline_tables(spark, tmp_path, [], [])
    assert c.run(spark, str(tmp_path)).count() == 0


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Nulls, repeated rows, ids that several texts share, and rows without an id."""
    import corpus_pipeline as c

    item = prose(30, 501)
    texts = [prose(60, 502), prose(60, 502), edited(prose(60, 502), 1, 1), prose(50, 503), prose(50, 503) + " " + item, None, "", prose(50, 504), prose(50, 504), "b c", "b c"]
    ids = [4, 4, 2, 7, 7, 8, 9, None, None, None, 11]
    docs = pipeline_tables(spark, tmp_path, texts, [(1, item), (1, prose(30, 505))], ids)
    rows = list(zip(ids, texts, strict=True))
    of = lambda df: sorted(((x["doc_id"], x["text"]) for x in df.collect()), key=repr)
    group = {k: g for k, (_, g) in classes_brute(dict(enumerate(texts))).items()}
    want = []
    for g in set(group.values()):
        own = [rows[k] for k in group if group[k] == g]
        want.append(min(own, key=lambda x: (x[0] is None, x[0] or 0)))
    assert of(c.near_duplicates(spark, docs, str(tmp_path))) == sorted(want, key=repr)
    assert of(c.decontamination(spark, docs, str(tmp_path))) == sorted((x for x in rows if not x[1] or item not in x[1]), key=repr)
    good = [x for x in rows if x[1] and statistics_brute(x[1])[0] >= 10]
    assert of(c.quality_rules(spark, docs, str(tmp_path))) == sorted(good, key=repr)
    assert c.near_duplicates(spark, docs, str(tmp_path)).columns == docs.columns
    assert {x["doc_id"] for x in c.repeated_lines(spark, docs, str(tmp_path)).collect()} >= {2, 7, 8, 9}


def test_texts_of_lines_are_kept_once(spark, monkeypatch):
    kept, saved = {}, line_dedup.saved
    monkeypatch.setattr(line_dedup, "texts_of", lambda *a: pytest.fail("texts fetched from the documents"))
    monkeypatch.setattr(line_dedup, "saved", lambda df, name, tidy=False: kept.setdefault(name, df.columns) and saved(df, name, tidy))
    line = "a line of a few words that is found in both of these texts, but for an end"
    got = line_dedup.dedup(table(spark, [line + " here", line + " there", None, ""]))
    assert [r["n_removed"] for r in got.orderBy("doc_id").collect()] == [0, 1, 0, 0]
    assert kept["line-table"] == ["id", "th", "pos", "k"] and "line" in kept["lines"]


def test_bound_by_characters_is_short_and_equals_a_plain_count(spark):
    r = random.Random(3)
    lines = ["".join(r.choice("etaoin srhldcumpfgywbvk.xé") for _ in range(r.choice([0, 3, 40, 300]))) for _ in range(60)] + ["e" * 5000, "e" * 4000 + "t" * 3000, (" " + "eta.") * 900]
    rows = spark.createDataFrame([(a, b, k % 50) for k, a in enumerate(lines) for b in lines], "la string, lb string, allowed int")
    bags = [x.alias(c + s) for s in "ab" for c, x in zip(line_dedup._BAGS, line_dedup._bags(F.col("l" + s)), strict=True)]
    near = line_dedup._bags_near("a", "b", F.col("allowed"))
    got = {(x["la"], x["lb"], x["allowed"]): x["near"] for x in rows.select("*", *bags).select("la", "lb", "allowed", near.alias("near")).collect()}
    counts = {x: [min(x.count(c), line_dedup._MOST) for c in "".join(line_dedup._BAG)] for x in lines}

    def apart(a, b):
        over = sum(max(m - n, 0) for m, n in zip(counts[a], counts[b], strict=True))
        return over + max(sum(counts[b]) - sum(counts[a]), 0)

    assert got == {(a, b, n): apart(a, b) <= n for a, b, n in got} and len(set(got.values())) == 2
    assert str(near).count("c0a") <= 4  # a condition that repeats its columns is too long to be compiled


def test_texts_of_lines_are_not_broadcast(spark, monkeypatch):
    """pipeline: no number of lines is sent to the driver to find their texts."""
    monkeypatch.setattr(line_dedup.F, "broadcast", lambda d: pytest.fail("broadcast"))
    docs = spark.createDataFrame([(1, "One  line\n two"), (None, "three\nOne line"), (1, "one line"), (4, None)], "doc_id long, text string")
    table = line_dedup._normal_lines(docs, "doc_id", "text").withColumn("k", F.xxhash64("line"))
    wanted = table.groupBy("k").agg(F.min(F.struct("id", "th", "pos")).alias("at"), F.min("line").alias("want"))
    got = {r.k: r.line for r in line_dedup.texts_of(wanted, docs, "doc_id", "text").collect()}
    assert got == {r.k: r.want for r in wanted.collect()} and set(got.values()) == {"one line", "two", "three"}


def test_pairs_of_common_keys_are_bounded_by_runs_that_lose_none(spark):
    """op2_line_dedup: before texts are fetched, lines of a common key are told apart by runs of characters; no pair within the distance is lost."""
    r = random.Random(41)
    rows = []
    for k in range(120):
        a = "".join(r.choice("etaoin srhé😀") for _ in range(r.choice([0, 5, 6, 7, 40, 300])))
        w = list(a)
        for _ in range(n := r.randint(0, 12)):
            at = r.randrange(len(w) + 1)
            w[at : at + 1] = r.choice(([], ["x"], [r.choice("etaoin"), *w[at : at + 1]]))
        rows += [(a, "".join(w), n, True), (a, "".join(r.choice("etaoin srhé😀") for _ in a), len(a) // 10, None)]
    near = line_dedup._runs_near(line_dedup._runs(F.col("lb"), True), line_dedup._runs(F.col("la")), F.col("allowed"))
    got = spark.createDataFrame(rows, "la string, lb string, allowed int, within boolean").withColumn("near", near).collect()
    assert all(x["near"] for x in got if x["within"])
    assert sum(not x["near"] for x in got if not x["within"] and len(x["la"]) == 300) > 5


def test_line_tables_hold_neither_sketches_nor_counts(spark, monkeypatch):
    """pipeline, op2_line_dedup: a line's sketch goes into its keys and is not stored; counts of characters are stored once a line, not once a key."""
    kept, saved = {}, line_dedup.saved
    monkeypatch.setattr(line_dedup, "saved", lambda df, name, tidy=False: kept.setdefault(name, df.columns) and saved(df, name, tidy))
    line = "a line of a few words that is found in both of these texts, but for an end"
    got = line_dedup.dedup(table(spark, [line + " here", line + " there", None, ""]))
    assert [r["n_removed"] for r in got.orderBy("doc_id").collect()] == [0, 1, 0, 0]
    assert kept["lines"] == ["k", "at", "rows", "line", "chars"]
    assert kept["bags"] == ["k", *line_dedup._BAGS] and not any({*line_dedup._BAGS} & {*kept[x]} for x in ("placed", "grouped", "split-keys"))
