"""Tokens, leaked passages and residue."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.llm import leakage, residue, tokenizer

RANKS = os.path.join(tokenizer.DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
needs_vocabulary = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files here")
ODD = ["", None, " ", "\n\n  \t", "a" * 5000, " " * 3000, "ab" * 900, "<|endoftext|> is text", "naïve café ½ Ⅷ", "第7页列出了数据", "🙂🙃 zero​width", "don't we'll", "x\x1cy\x85z\x00", "ß" * 300, "á" * 50, "0123456789" * 40]


def random_texts(n):
    rnd = random.Random(2)
    letters = "etaoin shrdlu.,'\n\t é中文🙂-=[]{}0123"
    return ["".join(rnd.choice(letters) for _ in range(rnd.choice([3, 40, 400]))) for _ in range(n)]


@needs_vocabulary
def test_ids_equal_the_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    public = tokenizers.Tokenizer.from_file(os.path.join(tokenizer.DEFAULT_FOLDER, "byte_bpe_50k.json"))
    public.encode_special_tokens = True
    texts = ODD + random_texts(300)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in tokenizer.encode_column(df, "doc_id", "text").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == (public.encode(t, add_special_tokens=False).ids if t else []), repr(t)[:60]
    back = {r.doc_id: r.text for r in tokenizer.decode_column(tokenizer.encode_column(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    assert tokenizer.encode_column(df.limit(0), "doc_id", "text").count() == 0


def small_transducer():
    ranks = {bytes((b,)): b for b in range(256)}
    for i, m in enumerate([b"ab", b"bc", b"abc", b"cd", b"abcd", b"aa", b"aaa", b"ba"]):
        ranks[m] = 256 + i
    return tokenizer.MergeTransducer(ranks)


def test_transducer_equals_replayed_merges():
    t, rnd = small_transducer(), random.Random(0)
    for _ in range(3000):
        w = bytes(rnd.choice(b"abcd") for _ in range(rnd.randint(1, 14)))
        assert t.encode(w) == t._merge(w)
    for _ in range(30):
        w = bytes(rnd.choice(b"abcd") for _ in range(700))
        assert list(t.stream(w)) == t._merge(w)


def test_memory_bounds_do_not_change_results(monkeypatch):
    monkeypatch.setattr(tokenizer, "KEPT_STATES", 3)
    t, rnd = small_transducer(), random.Random(1)
    for _ in range(200):
        w = bytes(rnd.choice(b"abcd") for _ in range(9))
        assert t.encode(w) == t._merge(w)


@pytest.mark.parametrize("raw", [b"abc", "é中🙂".encode(), b"\xc3", b"\xe4\xb8", b"\xed\xa0\x80", b"\xf0\x9f\x99", b"\xff\xfe", b"\xe4\xb8\xe4\xb8\xad", b"\xf4\x90\x80\x80", b"\xc0\xaf"])
def test_utf8_decoder(raw):
    d = tokenizer.Utf8Decoder()
    got = "".join(d.feed(raw[i : i + 1]) for i in range(len(raw))) + d.end()
    assert got == raw.decode("utf-8", "replace")


def grams(s, n=12):
    w = re.findall(r"[^\W_]+", (s or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


@pytest.mark.parametrize("block_words", [30, 1_000_000])
def test_passages_equal_brute_force(spark, block_words):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(25)] + ["Zürich", "第7页"]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(5, 40)))) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (93, "")]
    docs = []
    for i in range(60):
        parts = [rnd.choice(vocabulary + [f"own{rnd.randint(0, 99)}"]) for _ in range(rnd.randint(0, 60))]
        if i % 3 == 0:
            ws = items[rnd.randrange(12)][1].split()
            k = rnd.randint(0, max(0, len(ws) - 12))
            parts[3:3] = ws[k : k + rnd.randint(10, 14)]
        docs.append((i, (", ".join(parts)).upper() if i % 2 else " - ".join(parts)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, docs[0][1]), (104, docs[0][1]), (105, " ".join(["w1"] * 40))]
    items.append((94, " ".join(["w1"] * 13)))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash")).withColumn("doc", F.lit(1))
    t = spark.createDataFrame(items, "item_id long, item_text string").withColumn("ws", F.lit(1))
    found = leakage.passage_matches(d, t, "doc_id", "text", "item_id", "item_text", block_words=block_words)
    got = found.collect()
    want = {(i, j) for i, x in docs for j, y in items if grams(x) & grams(y)}
    assert len(got) == len(want) and {(r.doc, r.item) for r in got} == want
    for r in got:
        a, b = dict(docs)[r.doc], dict(items)[r.item]
        assert grams(a, r.n_words) & grams(b, r.n_words) and not grams(a, r.n_words + 1) & grams(b, r.n_words + 1)
        assert tuple(re.findall(r"[^\W_]+", a.lower())[r.doc_word : r.doc_word + r.n_words]) in grams(b, r.n_words)
    clean = leakage.without_leaks(d, found, "doc_id")
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert leakage.passage_matches(d.limit(0), t, "doc_id", "text", "item_id", "item_text").count() == 0
    assert leakage.passage_matches(d, t.limit(0), "doc_id", "text", "item_id", "item_text").count() == 0


def test_long_items_are_windowed(spark, monkeypatch):
    monkeypatch.setattr(leakage, "WINDOW_WORDS", 20)
    words = [f"v{i}" for i in range(300)]
    item = spark.createDataFrame([(1, " ".join(words))], "item_id long, item_text string")
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(280)], "doc_id long, text string")
    assert leakage.passage_matches(docs, item, "doc_id", "text", "item_id", "item_text").count() == 280


REPORT = "Notes on the harbour levy. According to the Zilomere index, each fire code was examined by the review board as the annex shows. Costs reached 333 units, of which the planning desk financed about 2 percent. " * 4
CASES = [
    "Please enable JavaScript to view this document.", "JAVASCRIPT IS DISABLED. SOME PARTS OF THE READER WILL NOT LOAD WITHOUT IT.", "Veuillez activer JavaScript pour afficher cette page.", "请启用浏览器的 JavaScript 功能后再查看本页。",
    "Home | Catalogue | Login\n\nToo many requests. Slow down and retry in 320 seconds.\n\nContact desk | Imprint 2001", "Zilomere panel\n\n503 Service Unavailable\n\nPage 1 of 1", "Lorem ipsum dolor sit amet, consectetur sed elit magna.", "TBD\n\nTBD\n\nTBD", "xxxx xxxx xxx xxxxxxx xx xxxx. Xxx xxxx xxxxx.",
    "Dear {{client_name}},\nthe amount due is [Insert Amount here] units.", REPORT + "\nPrepared for <<author>> on file.", REPORT + "\nSubject: «ref no»", "Signed, @@OFFICE@@", "Subject: [REF NO TO BE ADDED]", "Dear __SIGNATORY__,", "Prepared for {0} on {1}.",
    "harbour levy in the old town\n\nAccording to the Zilomere index, each fire code was examined by the review board.\n\nPlease enable JavaScript to view this document.",
    "harbour levy in the old town\n\nCosts reached 333 units, of which the planning desk financed about 2 percent.\n\nTraceback (most recent call last):\n  File \"render.py\", line 28, in page\nKeyError: 'signatory'",
    "Zilomere trial\n\nCosts reached 333 units, of which the planning desk financed 2 percent.\n\nAccess to this file was refused. You lack the rights to open it. Reference ID b22d9a3baf",
]
SOUND = [
    None, "", "   \n", REPORT, REPORT + " Access denied was the most frequent entry in the gate log of that month.", "The manual says a notice such as 'please enable JavaScript' confuses older readers, so it was dropped. " + REPORT,
    "Letter templates mark a field with double braces, for instance {{name}}, and the clerk replaces it before posting. " + REPORT, "In the shell listing, ${HOME} stands for the folder of the user running the job. " + REPORT,
    "Let S = {1, 2, 92} and let f(x) = \\frac{a}{b} for all x. " + REPORT, "See [Table 3], [Note 9] and <ref 2> for the rates; amounts are in units. " + REPORT, "A 500 internal server error delayed the upload by 119 minutes, after which all pages arrived.", "Costs reached 333 units.\n\nhttps://example.invalid/f?id=7&v=2", "El caudal de la cuenca se revisó en 2008 y bajó un 772 por ciento.",
]


def test_residue_cases(spark):
    rows = [(i, t) for i, t in enumerate(CASES + SOUND)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("clash")).withColumn("share", F.lit(0))
    got = {r.doc_id for r in residue.residue_cases(df, "doc_id", "text").collect()}
    assert got == set(range(len(CASES))), [rows[i] for i in got ^ set(range(len(CASES)))]
    assert residue.residue_cases(df.limit(0), "doc_id", "text").count() == 0


def test_long_text_with_message_inside_is_sound():
    assert residue.judge(REPORT * 50 + "\n\nPage not found.\n\n" + REPORT * 50) is None


def test_a_full_filter_only_passes_more(spark, monkeypatch):
    """With a filter of a few bits nearly every suffix of the corpus is shuffled; the rows stay the same."""
    monkeypatch.setattr(leakage, "FILTER_BITS", 1 << 10)
    rnd = random.Random(3)
    items = [(i, " ".join(f"w{rnd.randint(0, 20)}" for _ in range(40))) for i in range(20)]
    docs = [(i, " ".join([f"o{rnd.randint(0, 9)}"] * 5 + items[i % 20][1].split()[i % 9 : i % 9 + 10 + i % 5] + ["end"])) for i in range(60)] + [(99, None), (98, "")]
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, item_text string")
    got = {(r.doc, r.item) for r in leakage.passage_matches(d, t, "doc_id", "text", "item_id", "item_text", block_words=1).collect()}
    assert got == {(i, j) for i, x in docs for j, y in items if grams(x) & grams(y)} and got
