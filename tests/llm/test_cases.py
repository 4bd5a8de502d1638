"""Short benchmark items, templates without usual words, letters, and columns of callers that clash with those of operators."""

import random
import textwrap

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, licenses, line_dedup, quality

r = random.Random(12)
WORDS = ["".join(r.choice("klmnoprs") for _ in range(r.randint(2, 7))) for _ in range(300)]


def prose(n, seed):
    own = random.Random(seed)
    return " ".join(own.choice(WORDS) for _ in range(n))


def test_short_items_are_found_inside_longer_texts(spark):
    items = {1: "Zwei", 2: "what is two", 3: "one of the four", 4: "qq qq", 5: prose(30, 1)}
    texts = {0: prose(40, 2), 1: "tell me what is two plus three and so on until it ends", 2: prose(9, 3) + " ONE of THE four " + prose(70, 4), 3: "what is", 4: "zwei", 5: prose(12, 5) + " zwei", 6: "what is two", 7: "a qq qq qq b", 8: "what two is", 9: None, 10: ""}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): (x["start_word"], x["similarity"]) for x in decontam.contaminated(docs, bench).collect()}
    want = {}
    for d, t in texts.items():
        w = (t or "").lower().split()
        for i, item in items.items():
            v = item.lower().split()
            hits = [p for p in range(len(w) - len(v) + 1) if w[p : p + len(v)] == v]
            if len(v) < 5 and hits:
                want[d, i] = (hits[0], 1.0)
    assert got == want and len(want) == 6


def test_templates_of_any_wording_are_found(spark):
    made = {"Alpha": (prose(60, 21),), "Beta": ("zorp blik fum.",), "Gamma": (prose(260, 22),), "Plain": ("You may use it.",)}
    texts, want = [], []
    own = random.Random(3)
    for name, (t,) in made.items():
        words = t.split()
        for share in (0.0, 0.05, 0.09):
            changed = list(words)
            for k in own.sample(range(len(words)), int(share * len(words))):
                changed[k] = "qqq"
            texts.append(prose(80, own.random()) + "\n" + ("\n# ".join(textwrap.wrap(" ".join(changed), 60)) if share else " ".join(changed)) + "\n" + prose(50, own.random()))
            want.append(name)
    texts += [prose(300, 5), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x["license"] for x in licenses.scan(docs, templates=made).collect()}
    assert got == dict(enumerate(want))


def test_cues_leave_one_word_whatever_is_edited():
    cues = licenses.Cues(licenses.TEMPLATES, 0.1)
    own = random.Random(8)
    for ts in licenses.TEMPLATES.values():
        for t in ts:
            words = t.split()
            for _ in range(20):
                changed = list(words)
                for k in own.sample(range(len(words)), int(0.1 * len(licenses.tokens(t)))):
                    changed[k] = "qqq"
                assert cues.places(" ".join(changed)), t
    assert (3, 11) in cues.places("İİ Licensed under") and licenses.Cues({}, 0.1).places("x") == []


def test_numerals_are_no_letters(spark):
    assert not langid.has_letter("²³ ½ ¼ Ⅷ 12 _") and langid.has_letter("½ é") and not langid.has_letter("")
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de")] * 20)] + [(100, "²³ ½ ¼", None), (101, "Ⅷ", "de")], "doc_id long, text string, lang string")
    got = {x["doc_id"]: x["lang_pred"] for x in langid.identify(docs).collect()}
    assert got[100] == got[101] == "und" and got[0] == "en"


CLASHING = {"rule": "mine", "n_lines": "seven", "n_words": "w", "kept": "no", "__id": "i", "__q_text": "q", "__counted": "c", "n_removed": "r", "base_failed": "b"}


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [prose(60, 40) + "\n" + prose(30, 41), prose(60, 42) + "\n" + prose(30, 41), "too short", None, ""]
    docs = spark.createDataFrame([(k, t, len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    return docs.withColumns({c: F.lit(v) for c, v in CLASHING.items()})


def test_columns_of_callers_stay(spark, clashing, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.repeated_lines):
        out = stage(spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns and out.schema == clashing.schema or [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
        rows = out.collect()
        assert rows and all(x[c] == v for x in rows for c, v in CLASHING.items())
    assert {x["doc_id"] for x in corpus_pipeline.quality_rules(spark, clashing, str(tmp_path)).collect()} == {0, 1}
    lines = {x["doc_id"]: x["text"] for x in corpus_pipeline.repeated_lines(spark, clashing, str(tmp_path)).collect()}
    assert "\n" in lines[0] and "\n" not in lines[1] and lines[3] is None
    assert corpus_pipeline.quality_rules(spark, clashing.limit(0), str(tmp_path)).count() == 0 == corpus_pipeline.repeated_lines(spark, clashing.limit(0), str(tmp_path)).count()


def test_operators_leave_other_columns_alone(spark, clashing):
    kept = [c for c in CLASHING if c not in ("n_lines", "n_removed")]
    assert all(x[c] == CLASHING[c] for x in line_dedup.dedup(clashing).collect() for c in kept)
    made = ("n_lines", "n_words", "rule", "kept", "base_failed")
    judged = quality.judge(clashing, spark.createDataFrame([], "doc_id long, quality int"))
    assert all(x[c] == v for x in judged.collect() for c, v in CLASHING.items() if c not in made)
    assert {x["doc_id"] for x in judged.where("kept").collect()} == {0, 1}
