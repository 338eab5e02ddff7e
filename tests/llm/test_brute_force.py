"""Operators that SQL can't express, against plain versions: all pairs, exact packers, loops over letters."""

import random
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strataloom.llm import langid, line_dedup, mjpeg, ngram_join, packing, textkernel, toxicity, vafile
from strataloom.llm.common import prepare
from tests.llm.test_text_operators import DOCS, brute_links, frame, phrase


@pytest.fixture(autouse=True)
def _batches(spark):
    prepare(spark)


def groups_of(n, links):
    """The least member of each one's connected group."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    return [find(x) for x in range(n)]


def as_bytes(lines):
    """The lines with each letter replaced by an ASCII character of its own."""
    letters = sorted(set("".join(lines)))
    assert len(letters) <= 94
    return ["".join(x) for x in (map({c: chr(33 + i) for i, c in enumerate(letters)}.get, t) for t in lines)]


def near_lines(lines):
    """All pairs at edit similarity 0.8 or more, by another engine's distance (which counts bytes, so letters become bytes first)."""
    lines = as_bytes(lines)
    con = duckdb.connect()
    con.execute("CREATE TABLE l (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO l VALUES (?, ?)", list(enumerate(lines)))
    return con.execute("""SELECT a.i, b.i FROM l a JOIN l b ON a.i < b.i AND least(len(a.t), len(b.t)) >= 0.8 * greatest(len(a.t), len(b.t)) - 1e-9
        WHERE levenshtein(a.t, b.t) <= floor(0.2 * greatest(len(a.t), len(b.t)) + 1e-9)""").fetchall()


def test_similar_equals_another_engine():
    rng = random.Random(2)
    a, b = [], []
    for k in range(1500):
        x = phrase(rng, rng.randint(1, 70)) if k % 7 else "".join(rng.choice("漢字かな交じり文") for _ in range(rng.randint(1, 90)))
        y = list(x)
        for _ in range(rng.randint(0, len(y) // 3)):
            p = rng.randrange(len(y) + 1)
            y[p : p + rng.randint(0, 2)] = rng.choice(["", "x", "yz"])
        if k % 3 == 0:  # a head more, a tail less
            y = list("head of words " * rng.randint(1, 4)) + y[: -rng.randint(1, 30)]
        a.append(x)
        b.append("".join(y))
    con = duckdb.connect()
    plain = as_bytes(a + b)
    want = [con.execute("SELECT levenshtein(?, ?)", [p, q]).fetchone()[0] <= int(0.2 * max(len(x), len(y)) + 1e-9) for x, y, p, q in zip(a, b, plain, plain[len(a) :])]
    assert line_dedup.similar(a, b, 0.8).tolist() == want
    assert [line_dedup.edit_similarity(x, y, 0.8) >= 0.8 - 1e-9 for x, y in zip(a, b)] == want


def test_line_dedup_on_a_table_equals_all_pairs(spark, sf):
    """Lines of the smallest table that are short enough to compare them all: what is removed is right, and little is missed."""
    lines = sorted({line_dedup.normal_line(x) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for x in r["text"].split("\n")} - {""}, key=lambda t: (len(t), t))[:800]
    pairs = near_lines(lines)
    root = groups_of(len(lines), pairs)
    want = {i for i, r in enumerate(root) if r != i}
    gone = {r["doc"] for r in line_dedup.repeated_lines(frame(spark, lines)).collect()}
    assert gone <= want and len(gone) >= 0.9 * len(want) and want


@pytest.mark.parametrize("n", [1_000, 10_000, 100_000])
def test_line_recall_at_sizes(spark, n):
    """Planted partners at edit similarity 0.8 to 1 among n lines: 0.9 of them are found at any size, and nothing else."""
    rng = random.Random(n)
    vocabulary = [phrase(rng, 1) for _ in range(3000)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 40))) for _ in range(n - 300)]
    near = []
    while len(near) < 300:
        k = rng.randrange(n - 300)
        w = lines[k].split()
        for i in rng.sample(range(len(w)), rng.randint(1, max(1, len(w) // 5))):
            w[i] = rng.choice(vocabulary)
        if line_dedup.edit_similarity(lines[k], " ".join(w), 0.8) >= 0.8 - 1e-9:
            near.append(" ".join(w))
    texts = ["\n".join(lines[i : i + 100]) for i in range(0, len(lines), 100)]
    docs = frame(spark, texts + near)
    gone = {r["doc"]: r["gone"] for r in line_dedup.repeated_lines(docs).collect()}
    late = set(range(len(texts), len(texts) + 300))
    assert len(late & set(gone)) >= 0.9 * 300
    assert sum(len(p) for d, p in gone.items() if d not in late) <= 3  # planted lines apart, random ones are hardly ever alike


def test_large_clusters_are_dealt_by_band(spark, monkeypatch):
    """A cluster beyond a block gives what one task gives."""
    rng = random.Random(12)
    base = phrase(rng, 30).split()
    texts = []
    for _ in range(150):
        w = list(base)
        for i in rng.sample(range(30), 2):
            w[i] = phrase(rng, 1)
        texts.append(" ".join(w))
    root = groups_of(150, near_lines(texts))
    for block in (2048, 40):
        monkeypatch.setattr(line_dedup, "BLOCK", block)
        gone = {r["doc"] for r in line_dedup.repeated_lines(frame(spark, texts)).collect()}
        assert gone == {i for i, r in enumerate(root) if r != i}


def test_lines_and_classes_with_odd_rows(spark):
    """Null ids, repeated rows, repeated ids with other texts, and a long line that comes in slices."""
    rng = random.Random(5)
    long = phrase(rng, 40_000)
    other = long.replace(" ", "  ", 3) + " end"
    rows = [(1, "same line here once more"), (1, "same line here once more"), (None, "same line here once more"), (None, None), (2, long), (3, other), (4, "a"), (4, "b"), (5, "a")]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, _n string, lo string")
    got = line_dedup.clean(docs).collect()
    assert sorted(str((r["doc_id"], r["text"] if r["doc_id"] not in (2, 3) else len(r["text"]))) for r in got) == sorted(map(str, [(1, "same line here once more"), (1, "same line here once more"), (None, ""), (None, None), (2, len(long)), (3, 0), (4, "a"), (4, "b"), (5, "")]))
    found = {(r["doc_id"], r["class_id"], r["n_copies"], r["n_links"]) for r in ngram_join.similarity_classes(docs).collect()}
    assert {(1, 1, 2, 2), (2, 2, 0, 1), (3, 2, 0, 1), (4, 4, 0, 0), (4, 4, 1, 1), (5, 4, 1, 1)} <= found


def test_postings_count_common_members(monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(ngram_join, "POSTINGS", 7)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint64)) for _ in range(30)]
    held = ngram_join.Postings(sets)
    for s in [*sets, np.array([999], np.uint64), np.zeros(0, np.uint64)]:
        assert held.common(s).tolist() == [len(set(s.tolist()) & set(t.tolist())) for t in sets]


def test_convolution_equals_loops(monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Network(rng.normal(size=(toxicity.BUCKETS, toxicity.DIM)).astype(np.float32), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS], rng.normal(size=24).astype(np.float32), rng.normal(size=24).astype(np.float32), 0.3, rng.normal(size=5))
    net.table[0] = 0
    texts = ["one", "the cat and the dog of the house", "", "der hund und die katze", "a b c d e f g " * 40]

    def plain(text):
        ids, _, votes = toxicity.word_ids([text])
        x = np.vstack([np.zeros((2, toxicity.DIM)), *[[sum(net.table[i].astype(float) for i in row)] for row in ids], np.zeros((2, toxicity.DIM))])
        tops = []
        for w, f in zip(toxicity.WIDTHS, net.filters):
            for k in range(toxicity.FILTERS):
                tops.append(max(sum(float(x[t + j] @ f[j][:, k]) for j in range(w)) for t in range(len(x) - 2)))
        z = np.maximum(np.array(tops) + net.bias, 0) @ net.out + net.out_bias - net.shift[toxicity.language(votes)[0]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    want = [plain(t) for t in texts]
    assert np.allclose(net.scores(texts), want, atol=1e-4)
    monkeypatch.setattr(textkernel, "SLICE", 64)
    monkeypatch.setattr(textkernel, "LONGEST", 16)
    assert np.allclose(net.scores(texts), want, atol=1e-4)


def test_language_machine_equals_loops():
    def plain_counts(text):
        letters = "".join(c if c.isalpha() else " " for c in textkernel.fold(text).replace("\0", " ")) + " "
        out = Counter()
        for n in (2, 3):
            for i in range(len(letters) - n + 1):
                h = 0
                for c in letters[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B1 % 2**32
                h = (h ^ h >> 15) * 0x85EBCA77 % 2**32
                out[h >> 20] += 1
        return out

    texts = ["Hello, World", "", "ß1é 漢字", "x" * 70, "the end\n"]
    got, letters = langid.counts(texts)
    for t, row, letter in zip(texts, got, letters):
        assert {i: int(n) for i, n in enumerate(row) if n} == dict(plain_counts(t)) and letter == any(map(str.isalpha, t))
    rng = np.random.default_rng(1)
    x = rng.random((60, langid.BUCKETS)).astype(np.float32)
    x[:20, :9] += 1
    x[20:40, 9:18] += 1
    model = langid.train(x / x.sum(1, keepdims=True), ["en"] * 20 + ["de"] * 20 + ["fr"] * 20)
    for t, lang, score in zip(texts, *model.predict(texts)):
        c = plain_counts(t)
        f = np.array([c[i] for i in range(langid.BUCKETS)]) / max(1, sum(c.values()))
        m = f @ model.weights + model.bias
        wins = lambda names, cols: max(names, key=lambda a: sum((m[k] > 0) == (model.pairs[k][0] == a) for k in cols if a in model.pairs[k]))  # noqa: E731, B023
        family = wins(*model.tiers[0])
        tier = model.tiers[1 + model.tiers[0][0].index(family)]
        assert lang == ("und" if not any(map(str.isalpha, t)) else wins(*tier) if len(tier[0]) > 1 else tier[0][0])


def exact_bins(sizes, capacity):
    """The fewest bins, by trying all ways."""
    best = [len(sizes)]
    order = sorted(sizes, reverse=True)

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(order):
            best[0] = len(rooms)
            return
        for i in {r: i for i, r in enumerate(rooms) if r >= order[k]}.values():
            rooms[i] -= order[k]
            place(k + 1, rooms)
            rooms[i] += order[k]
        place(k + 1, [*rooms, capacity - order[k]])

    place(0, [])
    return best[0]


def test_packing_needs_as_few_bins_as_an_exact_packer():
    rng = random.Random(8)
    more = 0
    for k in range(40):
        sizes = np.array([rng.randint(1, 100) if k % 2 else rng.choice([20, 30, 35, 45, 50, 55]) for _ in range(rng.randint(3, 11))])
        bins = packing.evolve(sizes, [], 100, k)
        used, want = int(bins.max()) + 1, exact_bins(sizes.tolist(), 100)
        assert want <= used <= want + 1
        more += used - want
    assert more <= 2


def test_frames_decode_to_their_samples():
    rng = np.random.default_rng(6)
    payload = rng.integers(0, 256, 64 * 70, dtype=np.uint8).tobytes()
    frames = mjpeg.encode_frames(payload)
    flat = np.frombuffer(payload + b"\0" * (-len(payload) % 2048), np.uint8).reshape(-1, 32, 64)
    data = mjpeg.write_avi(frames, 512, 256)
    luma, hist = mjpeg.decode_files([data], [mjpeg.parse_avi(data)])[0]
    for f, picture, own, h in zip(frames, flat, luma, hist):
        plane = mjpeg.decode_jpeg(f)[0]
        assert (plane == np.kron(picture, np.ones((8, 8), np.uint8))).all()
        assert (own.reshape(32, 64) == picture).all() and h.tolist() == np.bincount(plane.ravel() >> 3, minlength=32).tolist()


def test_cells_bound_every_score():
    rng = np.random.default_rng(7)
    m, q = rng.integers(-5000, 5000, (400, 12)), rng.integers(-5000, 5000, (30, 12))
    low, gap = vafile.Cells.of(m).bounds(q)
    s = q @ m.T
    assert (low <= s).all() and (s <= low + gap[:, None]).all() and (vafile.scores(m[:30], q) == np.einsum("ij,ij->i", m[:30], q)).all()
    big = np.full((1, 4), 1 << 40)
    assert vafile.scores(big, big).tolist() == [4 << 80]


def plain_lines(docs):
    """The line stage by all pairs."""
    seen = {}
    for d, text in sorted(docs.items()):
        for p, line in enumerate(text.split("\n")):
            if norm := line_dedup.normal_line(line):
                seen.setdefault(norm, []).append((d, p))
    lines = sorted(seen, key=lambda t: min(seen[t]))
    root = groups_of(len(lines), near_lines(lines))
    keep = {min(seen[lines[r]]) for r in set(root)}
    out = {}
    for d, text in docs.items():
        rest = [x for p, x in enumerate(text.split("\n")) if not line_dedup.normal_line(x) or (d, p) in keep]
        if len(rest) == text.count("\n") + 1 or any(map(line_dedup.normal_line, rest)):
            out[d] = "\n".join(rest)
    return out


def test_pipeline_equals_a_plain_one(spark, tmp_path):
    """Scores and languages as the models give them, then all pairs of lines and of 5-gram sets."""
    import corpus_pipeline

    rng = random.Random(17)
    shared = [phrase(rng, 25) for _ in range(6)]
    rows, labels = [], []
    for i in range(160):
        body = [phrase(rng, rng.randint(20, 40)) for _ in range(rng.randint(1, 4))]
        if i % 4 == 0:
            body.insert(rng.randrange(len(body) + 1), rng.choice(shared))
        if i % 5 == 0:
            w = body[-1].split()
            w[rng.randrange(len(w))] = "vileword"
            body[-1] = " ".join(w)
        if i % 9 == 8:  # a near copy of one line of the document before, and of nothing else
            w = rows[-1][1].split("\n")[0].split()
            w[len(w) // 2] = "other"
            body.append(" ".join(w))
        rows.append((i, "\n".join(body)))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(200, rows[3][1]), (201, "12 34 -- 5"), (202, ""), (203, shared[0])]
    folder = str(tmp_path)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scored = {r["doc_id"]: r["toxicity"] for r in toxicity.score(docs, net).collect()}
    left = {i: t for i, t in rows if scored[i] < 0.5 and any(map(str.isalpha, t))}
    assert 100 < len(left) < 150
    left = plain_lines(left)
    ids = sorted(left)
    links = brute_links([left[i] for i in ids])
    root = groups_of(len(ids), [(i, j) for i in links for j in links[i]])
    want = {ids[r] for r in set(root)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == want
    sizes = {}
    for r in got:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    from strataloom.llm import tokens

    enc = tokens.byte_encoder()
    assert sizes == {i: len(enc.ids(left[i])) + 1 for i in want}


LONG = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
import pyarrow as pa
from strataloom.llm import bpe, langid, line_dedup, mjpeg, ngram_join, packing, textkernel, tokens, toxicity
text = {text}
name = {name!r}
if name == "op1":
    n = sum(len(x[0]) for x in line_dedup.line_table([text])) + sum(len(line_dedup.read_lines(x)[-1]) for *_, x in line_dedup._line_runs([text]))
elif name == "op3":
    net = toxicity.Network(np.ones((toxicity.BUCKETS, toxicity.DIM), np.float32), [np.ones((w, toxicity.DIM, toxicity.FILTERS), np.float32) for w in toxicity.WIDTHS], np.zeros(24, np.float32), np.ones(24, np.float32), 0.0, np.zeros(5))
    n = net.scores([text])
elif name == "op6":
    size, payload = mjpeg.text_payload(text)
    data = mjpeg.write_avi(mjpeg.encode_frames(payload), 512, 256)
    n = len(mjpeg.decode_files([data], [mjpeg.parse_avi(data)])[0][0])
elif name == "op7":
    n = sum(len(x) for x in bpe.word_encoder(tokens.vocabulary("word_bpe_49k.json")).pieces(text))
elif name == "op9":
    n = [len(x) for x in ngram_join._sets([text], 5)]
elif name == "op10":
    n = langid.counts([text])[0].sum()
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10)
"""


@pytest.mark.parametrize("name", ["op1", "op3", "op6", "op7", "op9", "op10"])
@pytest.mark.parametrize("text", ["' '.join('word%d' % (i % 50021) for i in range(2_300_000))", "'x' * 20_000_000"], ids=["words", "one"])
def test_a_text_of_20_million_characters_takes_bounded_memory(name, text):
    from tests.conftest import ROOT

    done = subprocess.run([sys.executable, "-c", LONG.format(root=str(ROOT), text=text, name=name)], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-500:]
    assert int(done.stdout.split()[-1]) < 500


def test_distances_by_columns_equal_a_plain_table():
    """Whatever the bound, the length and the letters: the distance itself within the bound, more than the bound beyond it."""

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            below = [i]
            for j, y in enumerate(b, 1):
                below.append(min(row[j] + 1, below[-1] + 1, row[j - 1] + (x != y)))
            row = below
        return row[-1]

    rng = random.Random(8)
    for letters in ("ab", "abcdefgh ", "aé漢\U0001f600 "):
        for _ in range(150):
            a = [rng.choice(letters) for _ in range(rng.randint(1, 140))]
            b = [x if rng.random() < 0.8 else rng.choice(letters) for x in a for _ in range(rng.choice((0, 1, 1, 1, 1, 2)))]
            a, b = sorted(("".join(a), "".join(b)), key=len)
            if a:
                d = plain(a, b)
                for most in (0, d - 1, d, d + 3):
                    assert (line_dedup._distance(a, b, most) == d) if d <= most else (line_dedup._distance(a, b, most) > most)


def test_pairs_of_unlike_lengths_and_letters_are_compared_at_once(monkeypatch):
    """The same answers as pair by pair, and no pair goes alone."""
    rng = random.Random(9)
    a, b = [], []
    for k in range(240):
        letters = ("ab", "abcdefgh ", "aé漢\U0001f600 ")[k % 3]
        x = [rng.choice(letters) for _ in range(rng.choice((1, 7, 8, 9, 63, 64, 65, 200, 900)))]
        y = [c if rng.random() < 0.85 else rng.choice(letters) for c in x for _ in range(rng.choice((0, *[1] * 12, 2)))]
        a.append("é" + "".join(x) + "z")
        b.append("a" + "".join(y) + "y")
    want = [line_dedup.edit_similarity(x, y, 0.8) >= 0.8 - 1e-9 for x, y in zip(a, b)]
    assert 40 < sum(want) < 200
    monkeypatch.setattr(line_dedup, "_distance", None)
    assert line_dedup.similar(a, b, 0.8).tolist() == want


def test_normal_form_of_ascii_lines_is_that_of_any_line():
    rng = random.Random(5)
    for _ in range(500):
        x = "".join(chr(rng.randrange(128)) for _ in range(rng.randint(0, 40)))
        assert f"{line_dedup.normal_line(x)} é".strip() == line_dedup.normal_line(f"{x} é")


def test_lines_known_to_be_connected_are_not_compared_again(monkeypatch):
    rng = random.Random(3)
    base = [phrase(rng, 40).split() for _ in range(2)]
    lines = [" ".join([*w[:k], phrase(rng, 1), *w[k + 1 :]]) for w in base for k in range(30)]
    compared = []
    similar = line_dedup.similar
    monkeypatch.setattr(line_dedup, "similar", lambda x, y, least: compared.extend(zip(x, y)) or similar(x, y, least))
    n = len(lines)
    for known, most in (([*range(n)], n * n), ([k // 15 * 15 for k in range(n)], 20), ([k // 30 * 30 for k in range(n)], 0)):
        compared.clear()
        rows = {"cluster": [0] * n, "i": [0] * n, "j": [0] * n, "blk": [0] * n, "id": [*range(n)], "known": known, "line": lines}
        links = [r for x in line_dedup._verify(iter([pa.RecordBatch.from_pydict(rows)]), 0.8) for r in x.to_pylist()]
        assert len(compared) <= most
        assert len(links) == len(set(known)) - 2
        assert groups_of(n, [(r["a"], r["b"]) for r in links] + list(enumerate(known))) == [k // 30 * 30 for k in range(n)]
