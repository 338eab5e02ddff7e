"""Line dedup, n-gram join, toxicity and language ID against brute force and held-out rows."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from strataloom.llm import langid, line_dedup, ngram_join, textkernel, toxicity
from strataloom.llm.common import components, prepare, shared_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def _batches(spark):
    prepare(spark)


def frame(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)


def phrase(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n))


def test_kernel_words_match_a_plain_split():
    texts = ["Hello, wörld 12x", None, "", "--", "a\0b", "漢字 ok", "x" * 5000, "Σας"]
    w = textkernel.split_words(texts)
    plain = [re.findall(r"[^\W_]+", (t or "").replace("\0", " ").lower()) for t in texts]
    assert np.diff(w.first).tolist() == [len(p) for p in plain]
    seen = {}
    for word, h in zip([x for p in plain for x in p], w.hash.tolist()):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, x) for x in range(1001, 1100)]
    root = list(range(1200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = dict(components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect())
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(texts, threshold=0.8, n=5):
    sets = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()})
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    return links


def test_ngram_join_equals_brute_force(spark):
    rng = random.Random(3)
    base = [phrase(rng, 120) for _ in range(6)]
    texts = [None, "", "!!", "one two", "One, two!", "one two three"]
    for b in base:
        for k in range(9):
            words = b.split()
            for _ in range(k // 3):
                words[rng.randrange(len(words))] = phrase(rng, 1)
            texts.append(" ".join(words))
    texts += [base[0], base[0].upper()]
    got = {r["doc_id"]: r for r in ngram_join.similarity_classes(frame(spark, texts)).collect()}
    links = brute_links(texts)
    assert {i: got[i]["n_links"] for i in got} == {i: len(links[i]) for i in range(len(texts))}
    for i in range(len(texts)):
        todo, seen = [i], {i}
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        assert got[i]["class_id"] == min(seen)


def test_ngram_join_large_group_of_different_texts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 40)
    rng = random.Random(4)
    base = phrase(rng, 200).split()
    texts = []
    for _ in range(150):
        w = list(base)
        w[rng.randrange(200)] = phrase(rng, 1)
        texts.append(" ".join(w))
    rows = ngram_join.similarity_classes(frame(spark, texts)).collect()
    links = brute_links(texts)
    assert {r["doc_id"]: r["n_text_links"] for r in rows} == {i: len(links[i]) for i in range(150)}
    assert {r["class_id"] for r in rows} == {0}


def test_one_of_each_keeps_rows_and_columns(spark):
    rng = random.Random(6)
    a, b = phrase(rng, 50), phrase(rng, 50)
    rows = [(1, a, "x"), (2, a, "y"), (2, a, "z"), (None, a, "n"), (None, b, "n"), (5, b, "q"), (5, b, "q"), (6, None, "v"), (7, "", "w"), (7, "", "w")]
    got = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _extra string"))
    assert got.columns == ["doc_id", "text", "_extra"]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([rows[0], rows[5], rows[7], rows[8], rows[9]], got.schema).collect()))


def test_line_dedup_exact_and_fuzzy(spark):
    rng = random.Random(8)
    lines = [phrase(rng, 40) for _ in range(20)]
    near = lines[0].split()
    near[3] = "changed"
    near = " ".join(near)
    texts = ["\n".join(lines[:5]), "\n".join([near, lines[1].upper() + "!", lines[6], "", "---"]), None, "", lines[7] + "\n" + lines[7], "12 apples here today", "34 apples here today"]
    got = {r["doc_id"]: r for r in line_dedup.clean(frame(spark, texts)).collect()}
    assert got[0]["text"] == texts[0]
    assert got[1]["text"] in ("\n".join([lines[6], "", "---"]), "\n".join([near, lines[6], "", "---"]))
    assert got[2]["text"] is None and got[3]["text"] == ""
    assert got[4]["text"] == lines[7] and got[4]["n_gone"] == 1
    assert got[5]["n_gone"] == 0 and got[6]["text"] == ""


def test_line_dedup_never_removes_unlike_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gone = {(r["doc"], p) for r in line_dedup.repeated_lines(docs).collect() for p in r["gone"]}
    held = defaultdict(list)
    for r in docs.collect():
        for p, line in enumerate(map(line_dedup.normal_line, r["text"].split("\n"))):
            if line:
                held[line].append((r["doc_id"], p))
    exact = {o for v in held.values() for o in sorted(v)[1:]}
    assert exact <= gone
    stays = [line for line, v in held.items() if sorted(v)[0] not in gone]
    for line, v in held.items():
        if sorted(v)[0] in gone:
            assert any(line_dedup.edit_similarity(line, s, 0.6) >= 0.6 for s in stays)


def test_line_dedup_hears_pairs_with_many_changed_words(spark):
    """A typo in five of ten words: far apart by words, near by edit similarity."""
    rng = random.Random(21)
    texts, near = [], []
    for _ in range(400):
        a = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(10)]
        b = [w[:3] + "z" + w[4:] if i % 2 else w for i, w in enumerate(a)]
        texts.append(" ".join(a))
        near.append(" ".join(b))
    assert all(line_dedup.edit_similarity(a, b) >= 0.8 for a, b in zip(texts, near))
    gone = {r["doc"] for r in line_dedup.repeated_lines(frame(spark, texts + near)).collect()}
    assert gone <= set(range(400, 800)) and len(gone) >= 3


def test_line_search_recall_does_not_depend_on_size():
    """Keys are a function of the line alone, and enough pairs of lines with a fifth of the words replaced share one."""
    rng = random.Random(5)

    def word():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(7))

    for words, changed, least in ((15, 1, 0.99), (30, 1, 0.99), (20, 4, 0.9)):
        a = [[word() for _ in range(words)] for _ in range(400)]
        b = [list(x) for x in a]
        for x in b:
            for i in rng.sample(range(words), changed):
                x[i] = word()
        lines = [" ".join(x) for x in a + b]
        *_, line, key = line_dedup.read_lines("\n".join(lines))
        keys = [set(key[line == i].tolist()) for i in range(800)]
        assert np.mean([bool(keys[i] & keys[400 + i]) for i in range(400)]) >= least
        alone = line_dedup.read_lines(lines[7])[-1]
        assert set(alone.tolist()) == keys[7]


def test_line_dedup_does_not_depend_on_partitions(spark):
    """A crowd of variants of one line, and near copies of single members in other tasks."""
    rng = random.Random(31)
    base = phrase(rng, 24).split()
    crowd, near = [], []
    for _ in range(30):
        a = list(base)
        for i in rng.sample(range(24), 8):
            a[i] = phrase(rng, 1)
        b = list(a)
        b[rng.randrange(24)] = phrase(rng, 1)
        crowd.append(" ".join(a))
        near.append(" ".join(b))
    docs = frame(spark, crowd + near)
    got = [{r["doc"] for r in line_dedup.repeated_lines(docs.repartition(n)).collect()} for n in (1, 8)]
    found = {30 + i for i in range(30) if line_dedup.edit_similarity(crowd[i], near[i]) >= 0.8}
    assert got[0] == got[1] and len(found - got[0]) <= 1


def test_edit_similarity_equals_the_plain_one():
    rng = random.Random(1)

    def plain(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
            p = q
        return 1 - p[-1] / max(len(a), len(b))

    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        b = a[:5] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) + a[rng.randint(3, 9) :]
        e = plain(a, b)
        assert line_dedup.edit_similarity(a, b) == pytest.approx(e)
        g = line_dedup.edit_similarity(a, b, 0.8)
        assert g == pytest.approx(e) or (g < 0.8 and e < 0.8)


def _mixed(spark, n=400):
    rng = random.Random(11)
    words = {"en": "the of and to in that for".split(), "de": "der die und das den von zu".split()}
    docs, labels = [], []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        toxic = int(rng.random() < 0.3)
        body = [rng.choice(words[lang]) if rng.random() < 0.5 else phrase(rng, 1) for _ in range(40)]
        if toxic:
            body[rng.randrange(40)] = rng.choice(["vileword", "nastyword"])
        docs.append((i, " ".join(body), lang, "s", 0))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_scores_alike(spark):
    docs, labels = _mixed(spark)
    net = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, net).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in held]) >= 0.95
    odd = [None, "", "!!", "vileword " * 3, "x" * 200_000]
    alone = [net.scores([t])[0] for t in odd]
    assert np.allclose(alone, net.scores(odd)) and alone[0] == alone[1] == alone[2] and alone[3] > 0.5 > alone[0]
    few = toxicity.fit(docs, labels.where("toxic = 0"))
    assert (few.scores(["a", None]) < 0.5).all()


def test_language_id(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in held]) >= 0.97
    odd = [None, "", "123 !!", "the cat", "x" * 100_000]
    langs, scores = model.predict(odd)
    assert langs[:3] == ["und"] * 3 and set(langs[3:]) <= set(model.classes) and ((scores >= 0) & (scores <= 1)).all()
    assert [model.predict([t])[0][0] for t in odd] == langs
    none = langid.fit(docs.where("lang is null"))
    assert none.predict(["abc"])[0] == ["und"]
    assert langid.train(np.zeros((2, langid.BUCKETS), np.float32), ["xx", "xx"]).predict(["abc"])[0] == ["xx"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert line_dedup.clean(docs).count() == 0
    assert ngram_join.similarity_classes(docs).count() == 0
    assert ngram_join.one_of_each(docs).count() == 0
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 0
    assert langid.identify(docs, langid.fit(docs)).count() == 0


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == named.rstrip("/") if named else shared_dir(spark).startswith("file:")
