import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.llm import leakage, reading_level
from skein.llm.syllables import syllables
from skein.llm.split_text import LINE, NONE, PARAGRAPH, SENTENCE, WORD, SparseTable, cuts, split_texts, strengths

# ---- splitting


def slow_cuts(text, limit, overlap):
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    s = strengths(np.array([ord(c) for c in text], np.uint32))
    out, start = [], 0
    while len(text) - start > limit:
        low = start + min(max(limit // 2, 2 * overlap + 1), limit)
        best = max(range(low, start + limit + 1), key=lambda i: (s[i], i))
        end = best if s[best] else start + limit
        out.append((start, end))
        start = end - overlap
    return out + [(start, len(text))]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab. \n\r\t!中\U0001f600", max_size=400), st.integers(12, 60), st.integers(0, 5))
def test_cuts(text, limit, overlap):
    spans = cuts(text, limit, overlap)
    assert spans == slow_cuts(text, limit, overlap)
    assert all(0 < b - a <= limit for a, b in spans)
    assert all(spans[i + 1][0] == spans[i][1] - overlap for i in range(len(spans) - 1))
    assert "".join(text[a + (overlap if i else 0) : b] for i, (a, b) in enumerate(spans)) == text


def test_strengths():
    text = 'One. Two "x." Z\nb\n\nc d'
    s = strengths(np.array([ord(c) for c in text], np.uint32))
    at = {text[i]: int(s[i]) for i in range(len(text)) if s[i]}
    assert at == {"T": SENTENCE, '"': WORD, "Z": SENTENCE, "b": LINE, "c": PARAGRAPH, "d": WORD}
    assert s[1] == NONE


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.data())
def test_sparse_table(values, data):
    t = SparseTable(np.array(values), len(values))
    a = data.draw(st.integers(0, len(values) - 1))
    b = data.draw(st.integers(a, len(values) - 1))
    assert t.best(a, b) == max((values[i], i) for i in range(a, b + 1))


def test_split_rows(spark):
    long = "word " * 20_000
    df = spark.createDataFrame([(1, "a", long), (2, None, None), (3, "b", " \n\t"), (4, "c", "x" * 1600), (5, "d", "x" * 1601), (1, "a", long)], "id int, piece string, text string")
    out = split_texts(df)
    assert "source_piece" in out.columns
    got = out.collect()
    assert {r["id"] for r in got} == {1, 4, 5} and max(len(r["piece"]) for r in got) <= 1600
    assert sum(r["id"] == 1 for r in got) == 2 * len(cuts(long.strip()))
    assert [r["n_pieces"] for r in got if r["id"] == 5] == [2, 2]
    assert split_texts(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        cuts("x", 10, 6)


# ---- leakage


def slow_leaks(docs, items, n):
    windows = {}
    for i, t in items:
        w = leakage.words(t)
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = leakage.words(t or "")
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + n]), ())}
    return out


def make_leaks(seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghijklmno") for _ in range(r.randrange(1, 9))) for _ in range(120)] + ["é", "straße", "ﬁsh", "12"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(5, 60)))) for i in range(25)]
    docs = []
    for d in range(120):
        words = [r.choice(vocabulary) for _ in range(r.randrange(0, 200))]
        if d % 3 == 0:
            w = r.choice(items)[1].split()
            n = r.choice([11, 12, 13, 30])
            k = r.randrange(max(1, len(w) - n))
            part = w[k : k + n]
            if d % 2:
                part = [r.choice([p, p.upper(), f"**{p}**", p + ",", p[:1] + "​" + p[1:]]) for p in part]
            at = r.randrange(len(words) + 1)
            words[at:at] = part
        docs.append((d, r.choice([" ", "\n", "  - "]).join(words)))
    return docs + [(500, None), (501, ""), (502, "..!")], items


@pytest.mark.parametrize("seed", range(3))
def test_leaks_against_brute_force(spark, seed):
    docs, items = make_leaks(seed)
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (90, None), (91, "")], "item_id bigint, text string")
    want = slow_leaks(docs, items, 12)
    assert len(want) > 10
    assert {(r["doc_id"], r["item_id"]) for r in leakage.leaks(D, I).where("exact").collect()} == want
    blocks = leakage.leaks(D, I, block_bytes=1500)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.where("exact").collect()} == want


def test_passages_with_edits():
    item = "the quick brown foxes jumped over seventeen lazy dogs while the farmer slept beneath an old tree"
    (index,) = leakage.build_indexes([7], [item])
    assert index.edits == 2 and index.search(["noise " * 50 + item.replace("brown", "brawn") + " noise"])
    assert not index.search(["totally different text about nothing at all " * 20])
    assert leakage.build_indexes([], []) == leakage.build_indexes([1], ["too short"]) == []
    # An item of short words gets an index of its own and changes nothing for the others.
    short = "a b c d e f g h i j k l"
    both = leakage.build_indexes([7, 8], [item, short])
    assert sorted(x.q for x in both) == [7, 12] and [x for x in both if x.q == 12][0].length == index.length
    assert [x for x in both if x.q == 7][0].search([f"z {short} z"])
    with pytest.raises(ValueError):
        leakage.build_indexes([8], [short], edits=9)


def edited(r, words, edits):
    text = list(" ".join(words))
    for at in r.sample(range(1, len(text) - 1), edits):
        kind = r.randrange(3)
        text[at] = "" if kind == 0 else r.choice("qxz") if kind == 1 else text[at] + r.choice("qxz")
    return "".join(text)


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_recall_of_edited_passages(edits):
    """Every passage of twelve words with at most two edits of characters is found: the lemma loses none."""
    r = random.Random(edits)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(3, 10))) for _ in range(2000)]
    items = [" ".join(r.choice(vocabulary) for _ in range(60)) for _ in range(40)]
    (index,) = leakage.build_indexes(list(range(40)), items)
    texts, want = [], set()
    for d in range(200):
        i = r.randrange(40)
        w = items[i].split()
        k = r.randrange(len(w) - 12)
        noise = [r.choice(vocabulary) for _ in range(80)]
        texts.append(" ".join([*noise[:40], edited(r, w[k : k + 12], edits), *noise[40:]]))
        want.add((d, i))
    assert want <= {(t, i) for t, i, _ in index.search(texts)}


def test_index_is_compact():
    r = random.Random(4)
    texts = [" ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(500)) for _ in range(100)]
    (index,) = leakage.build_indexes(list(range(100)), texts)
    held = sum(x.nbytes for x in vars(index).values() if hasattr(x, "nbytes")) - index.bitmap.nbytes
    assert held < 30 * sum(map(len, texts))


def test_reduction_agrees_with_words():
    texts = ["Ünïcode ﬁne ＦＵＬＬ-width", "soft­hyphen a​b", "", "...", "x", " a  b ", "ASCII only, 42!", "ß ǅ"]
    for group in (texts, [t for t in texts if t.isascii()]):
        data, starts = leakage.reduce_texts(group, 5)
        for t, a in zip(group, starts):
            raw = bytes(data[a:])
            raw = raw[: raw.index(253)].rstrip(b" ")
            assert raw.count(b" ") == max(0, len(leakage.words(t)) - 1)
            assert len(raw) == len(" ".join(leakage.words(t)))


def test_empty_documents(spark):
    docs, items = make_leaks(9)
    D, I = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    assert leakage.leaks(D.limit(0), I).count() == 0 and leakage.leaks(D, I.limit(0)).count() == 0
    hay = ("filler " * 200_000) + items[0][1] * 2
    long = spark.createDataFrame([(1, hay), (1, hay)], "doc_id bigint, text string")
    assert leakage.leaks(long, I).where("exact").count() == 2 * len(slow_leaks([(1, hay)], items, 12))


# ---- reading level


def slow_prose(text):
    words = sentences = letters = 0
    inside = False
    for line in text.split("\n"):
        if line.lstrip(" \t").startswith("```"):
            inside = not inside
            continue
        if inside or line.startswith("#"):
            continue
        for part in re.split(r"(?<=[.!?])(?=\s)", line):
            found = re.findall(r"[^\W\d_]+", part)
            words += len(found)
            letters += sum(map(len, found))
            sentences += bool(found)
    return words, sentences, letters


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abeé #`\n\r.!? 1_中", max_size=60), min_size=1, max_size=6))
def test_counts(texts):
    p = reading_level.Prose(texts)
    assert list(zip(p.n_words.tolist(), p.n_sentences.tolist(), p.n_letters.tolist())) == [slow_prose(t) for t in texts]


def test_counts_of_code_and_headings():
    p = reading_level.Prose(["# No\nYes it is. Dr.Who\n```py\nx. y\n```\nEnd", ""])
    assert p.n_words.tolist() == [6, 0] and p.n_sentences.tolist() == [3, 0]


SYLLABLES = {
    "en": "the1 table2 make1 reading2 nation2 idea3 area3 walked1 wanted2 houses2 orchestration4 special2 religion3 queen1 quiet2 people2 create2 being2 science2 video3 radio3 little2 statement2 completely3 serious3 society4 experience4 queue1 values2",
    "de": "die1 viel1 liebe2 spiel1 haus1 häuser2 familie3 familien4 linien3 wien1 museum3 idee2 ideen3 nation3 studien3 finanziell4 patient3 verdient2 beurteilen4 feuer2 freie2 quelle2 ruine3 boot1 staat1 theorie3 heroisch3 informationen6 situation5",
    "fr": "le1 table1 nation2 maison2 beaucoup2 bateau2 parlent1 parle1 qui1 quelque1 oublier3 prier2 lumière2 théâtre2 réaliste3 social2 nuit1 nuage2 oui1 lieu1 pied1 poète2 moment2 souvent2 langue1 guerre1",
    "es": "el1 casa2 bueno2 ciudad2 nación2 día2 país2 poeta3 leer2 que1 guerra2 pingüino3 río2 aéreo4 caos2 también2 estudiáis3 agua2 teoría4 idea3 oeste3 ahora3",
}


@pytest.mark.parametrize(("language", "word"), [(k, w) for k, v in SYLLABLES.items() for w in v.split()])
def test_syllables(language, word):
    assert syllables(word[:-1], language) == int(word[-1])


def test_syllables_in_texts():
    lead = {"en": "of the and is that it", "de": "der und ist nicht ein das", "fr": "le les des est et une", "es": "el los las del que y"}
    for language, text in SYLLABLES.items():
        words = [w[:-1] for w in text.split()]
        whole = f"{lead[language]} {lead[language]} {' '.join(words)}"
        p = reading_level.Prose([whole, "", f"{lead[language]} {lead[language]} {words[0].upper()}"])
        assert [reading_level.LANGUAGES[k] for k in p.language[[0, 2]]] == [language] * 2
        counts = [syllables(w, language) for w in whole.split()]
        assert int(p.n_syllables[0]) == sum(counts) and int(p.n_hard[0]) == sum(c > 2 for c in counts) and int(p.n_single[0]) == sum(c == 1 for c in counts)
        assert int(p.n_syllables[1]) == 0


def test_levels(spark):
    df = spark.createDataFrame([(1, "The cat sat. The dog ran. It was fun."), (2, "Notwithstanding considerable organizational interdependencies, administrators systematically underestimated infrastructural modernization expenditures throughout successive parliamentary investigations."), (3, None), (4, "```\ncode\n```")], "doc_id bigint, text string")
    out = {r["doc_id"]: r for r in reading_level.reading_levels(df).collect()}
    assert out[1]["grade"] < out[2]["grade"] and out[3]["grade"] is None and out[4]["n_words"] == 0
    assert reading_level.reading_levels(df.limit(0)).count() == 0


def test_cuts_separate_and_hold_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/level_labels.parquet")
    graded = reading_level.reading_levels(docs.join(labels.select("doc_id").distinct(), "doc_id", "left_semi")).cache()
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    bounds = reading_level.fit_cuts(graded, fit)
    assert bounds == sorted(bounds)
    told = held.join(graded, "doc_id").withColumn("level", reading_level.level_of(F.col("grade"), bounds)).where("level IS NOT NULL")
    error = told.agg(F.avg(F.abs(F.col("level") - F.col("reader_level")))).first()[0]
    assert error < 0.8, error
    graded.unpersist()
