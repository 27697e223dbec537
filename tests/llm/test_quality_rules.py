import random
import re
from collections import Counter

from sparkeda.llm import quality_rules as q
from tests.llm.conftest import article, make_docs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts(odd, odd_rows, spark):
    rows = [(i, t) for i, (_, t, *_) in enumerate(odd_rows)]
    rows += [(50, "a b c a b c a b c"), (51, "x " * 100), (52, "a b c d\na b c d\n\n \na b c d"), (53, "a b"), (54, "a a a a")]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in q.apply_rules(make_docs(spark, rows)).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_verdict(spark):
    good = article(1, lines=10)
    bad = {
        "short": "The of and.", "symbols": good.replace(" ", " ### "), "digits": " ".join(str(i) for i in range(300)) + " the of and " * 30,
        "no stop words": " ".join(f"word{'abcdefgh'[i % 8]}{'klmnopq'[i % 7]}{'rstuvw'[i % 6]}" for i in range(200)),
        "one line": "\n".join(f"{good.split(chr(10))[0]}" for _ in range(20)), "empty": "", "null": None,
    }
    docs = make_docs(spark, [(0, good), (0, good), *((i + 1, t) for i, t in enumerate(bad.values()))])
    kept = {(r.doc_id, r.kept) for r in q.apply_rules(docs).collect()}
    assert kept == {(0, True), *((i + 1, False) for i in range(len(bad)))}
    stayed = q.passing(docs)
    assert stayed.columns == docs.columns and [r.doc_id for r in stayed.collect()] == [0, 0]


def test_native_and_empty(odd, none):
    plan = q.apply_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
    assert q.apply_rules(none).count() == 0 and q.passing(none).count() == 0


def test_own_rules(spark):
    rules = (q.Rule("few words", "n_words", None, 3), q.Rule("letters", "letter_word_ratio", 0.5, None))
    docs = make_docs(spark, [(1, "a b"), (2, "a b c d"), (3, "1 2"), (4, "")])
    got = {r.doc_id for r in q.counts(docs).filter(q.verdict(rules)).collect()}
    assert got == {1}


def test_good_and_bad_of_the_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    both = q.apply_rules(docs).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("NOT base_failed").collect()
    assert all(r.kept for r in both if r.quality == 1)
    assert sum(r.kept for r in both if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in both)


CLEAN = {
    "ru": "Старый мост через реку построили ещё до войны, и жители города каждое утро переходили по нему на другой берег.",
    "el": "Το παλιό λιμάνι βρίσκεται στην άκρη της πόλης και κάθε πρωί οι ψαράδες φέρνουν εκεί τα ψάρια τους για την αγορά.",
    "ar": "يقع الميناء القديم على أطراف المدينة ويأتي إليه الصيادون كل صباح لبيع السمك في السوق الكبيرة قرب البحر.",
    "hi": "पुराना पुल नदी के ऊपर बना है और शहर के लोग हर सुबह इसे पार करके दूसरे किनारे के बाज़ार में जाते हैं।",
    "it": "Il vecchio ponte sul fiume fu costruito prima della guerra e gli abitanti della città lo attraversano per andare al mercato.",
    "pl": "Stary most na rzece zbudowano jeszcze przed wojną i mieszkańcy miasta chodzą po nim na targ, który jest za rzeką.",
    "fi": "Vanha silta on joen yli ja kaupungin asukkaat kulkevat sitä pitkin joka aamu, kun he menevät torille, mutta silta on kapea.",
    "tr": "Eski köprü nehrin üzerinde ve şehrin insanları her sabah bu köprüden geçerek pazara gider, çünkü pazar için başka bir yol yok.",
}


def test_clean_text_of_other_languages_stays(spark):
    def long(text):
        words = text.split(" ")
        return "\n".join(" ".join(random.Random(k).sample(words, len(words))) for k in range(6))

    docs = make_docs(spark, [(i, long(t)) for i, t in enumerate(CLEAN.values())])
    got = {r.doc_id: (r.base_failed, r.kept) for r in q.apply_rules(docs).collect()}
    assert {x: got[i] for i, x in enumerate(CLEAN)} == dict.fromkeys(CLEAN, (False, True))
