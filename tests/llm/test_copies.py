import numpy as np
import pytest

from tidewright.llm import queries, simhash, spans, vectors
from tidewright.llm.components import connected_components, forest


def components(n, pairs):
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_components(spark, seed):
    r = np.random.default_rng(seed)
    a, b = r.integers(0, 200, 150), r.integers(0, 200, 150)
    want = components(200, zip(a.tolist(), b.tolist(), strict=True))
    u, v = forest(a, b)
    got = dict(zip(u.tolist(), v.tolist(), strict=True))
    assert all(got.get(i, i) == want[i] for i in range(200))
    if seed < 2:
        chain = [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 50)]
        edges = spark.createDataFrame([*zip(a.tolist(), b.tolist(), strict=True), *chain, (None, 3), (5, 5)], "a long, b long").repartition(7)
        rows = connected_components(edges).collect()
        got = {r["node"]: r["component"] for r in rows}
        assert len(rows) == len(got) and all(got.get(i, i) == want[i] for i in range(200)) and got[1060] == 1000 and got[2049] == 2000
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_golay_code_is_perfect():
    r = np.random.default_rng(0)
    words = r.integers(0, 1 << 23, 500)
    code = words ^ simhash._errors()[simhash._remainder(words)]
    assert (simhash._remainder(code) == 0).all() and (np.bitwise_count(words ^ code) <= 3).all()
    assert len(set(simhash._errors().tolist())) == 2048


def test_keys_meet_within_three_bits():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 400, dtype=np.uint64)
    other = base.copy()
    for i in range(400):
        for b in r.choice(64, i % 4, replace=False):
            other[i] ^= np.uint64(1) << np.uint64(b)
    held = set(zip(*(x.tolist() for x in simhash.index_keys(other)), strict=True))
    met = {i for i, k in zip(*(x.tolist() for x in simhash.probe_keys(base)), strict=True) if (i, k) in held}
    assert met == set(range(400))


def brute_fingerprint(text, width=3):
    import xxhash

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_query_against_brute_force(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    fp = np.array([brute_fingerprint(t) for _, t in docs], np.uint64)
    near = np.argwhere(np.bitwise_count(fp[:, None] ^ fp[None]) <= 3)
    want = components(len(docs), near.tolist())
    got = {r["doc_id"]: r for r in queries.op7_simhash_near_dedup(spark, sf).collect()}
    assert len(got) == len(docs)
    for k, (i, _) in enumerate(docs):
        assert got[i]["fingerprint"] == f"{int(fp[k]):016x}" and got[i]["component_id"] == docs[want[k]][0] and got[i]["kept"] == (docs[want[k]][0] == i)


def test_simhash_edges(edge_docs, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    rows = simhash.near_duplicates(edge_docs).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == edge_docs.count() and {by[i]["fingerprint"] for i in (2, 3, 4)} == {"0" * 16} and {by[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert simhash.fingerprint("TWO words") == brute_fingerprint("two words")
    near = (int(by[5]["fingerprint"], 16) ^ int(by[6]["fingerprint"], 16)).bit_count() <= 3
    assert by[6]["component_id"] == (5 if near else 6)
    kept = simhash.keep_first(edge_docs)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edge_docs.columns and ids.count(1) == 1 and ids.count(None) == 1 and not {3, 4} & set(ids)


UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3000, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x33FFF))


def words_of(text):
    """(start, end) of each word, character by character."""
    out, at = [], None
    for i, c in enumerate(text):
        space, alone = c in " \t\n\x0b\x0c\r", any(a <= ord(c) <= b for a, b in UNSPACED)
        if (space or alone) and at is not None:
            out.append((at, i))
            at = None
        if alone:
            out.append((i, i + 1))
        elif not space and at is None:
            at = i
    return out + ([(at, len(text))] if at is not None else [])


def brute_spans(docs, least=50):
    """The text without each span of `least` words that stands before, from plain sets of words."""
    seen, out = set(), {}
    for i, text in docs:
        places = words_of(text)
        words = [text[a:b] for a, b in places]
        gone = [False] * len(words)
        for k in range(len(words) - least + 1):
            span = " ".join(words[k : k + least])
            if span in seen:
                gone[k : k + least] = [True] * least
            seen.add(span)
        begins = [a for a, _ in places] + [len(text)]
        out[i] = text[: begins[0]] + "".join(text[begins[k] : begins[k + 1]] for k in range(len(words)) if not gone[k])
    return out


def test_span_query_against_brute_force(spark, sf):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r for r in queries.op9_substring_dedup(spark, sf).collect()}
    want = brute_spans(docs)
    assert {i: r["text"] for i, r in got.items()} == want
    for i, text in docs:
        left, kept = 0, []
        places = [tuple(map(int, x.split("-"))) for x in got[i]["removed"].split(",") if x]
        for start, end in places:
            kept.append(text[left:start])
            left = end
        assert "".join(kept) + text[left:] == want[i] and got[i]["n_removed"] == len(places)


def test_planted_passages_go_and_clean_texts_stay(spark):
    r = np.random.default_rng(4)
    syllables = "an be con der en fer ga ho in jo ka lo mi ne on pa que ra se ti un ver wa".split()
    word = lambda: "".join(r.choice(syllables, r.integers(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(r.integers(4, 12))).capitalize() + "."
    passage = " ".join(sentence() for _ in range(9))
    own = [" ".join(sentence() for _ in range(8)) for _ in range(12)]
    docs = [(i, t if i % 2 else t.replace(" ", f" {passage} ", 1) if i % 4 else f"{t}\n{passage}") for i, t in enumerate(own)]
    got = {r["doc_id"]: r["text"] for r in spans.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(passage.split()) > 50 and got[0] == docs[0][1]
    for i, text in docs[1:]:
        assert got[i] == text if i % 2 else passage not in got[i] and set(own[i].split()) <= set(got[i].split())


def made(r, n):
    """Words without capitals and punctuation."""
    return ["".join(chr(97 + k) for k in r.integers(0, 26, r.integers(2, 9))) for _ in range(n)]


@pytest.mark.parametrize("script", ["bare", "prose", "han"])
def test_unaligned_passages_of_51_words_go_to_their_edges(spark, script):
    r = np.random.default_rng(8)
    draw = (lambda n: [chr(k) for k in r.integers(0x4E00, 0x9FA0, n)]) if script == "han" else lambda n: made(r, n)
    gap = "" if script == "han" else " "
    docs, want = [], {}
    for k in range(40):
        passage = draw(51)
        if script == "prose":
            passage = [w.capitalize() + "." if i % 23 == 9 else w for i, w in enumerate(passage)]
        for i in (2 * k, 2 * k + 1):
            head, tail = draw(int(r.integers(0, 90))), draw(int(r.integers(0, 90)))
            docs.append((i, gap.join([*head, *passage, *tail])))
            want[i] = [*head, *([] if i % 2 else passage), *tail]
    got = {d["doc_id"]: d["text"] for d in spans.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert {i: t.replace(" ", "") for i, t in got.items()} == {i: "".join(w) for i, w in want.items()}


def test_passages_of_49_words_stay_and_of_50_go(spark):
    r = np.random.default_rng(9)
    docs, want = [], {}
    for k, n in enumerate([49, 50] * 20):
        passage = made(r, n)
        for i in (2 * k, 2 * k + 1):
            head, tail = made(r, 30), made(r, 30)
            docs.append((i, " ".join([*head, *passage, *tail])))
            want[i] = " ".join([*head, *([] if i % 2 and n == 50 else passage), *tail])
    got = {d["doc_id"]: d["text"] for d in spans.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want


def test_span_edges(edge_docs, no_docs):
    assert spans.deduplicate(no_docs).collect() == []
    out = spans.deduplicate(edge_docs)
    rows = out.collect()
    gone = out.columns[-1]
    assert out.columns[:-1] == edge_docs.columns and gone not in edge_docs.columns and len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["text"] is None and by[3]["text"] == "" and by[8]["text"] == "x" * 50_000 and by[None][gone] == []
    assert len(by[5]["text"]) < 500 and by[6]["text"].endswith("Ende.") and len(by[6]["text"]) < 500
    assert [len(r[gone]) for r in rows if r["doc_id"] == 1] == [0, 0] and {r["__removed"] for r in rows} == {"r"}


def test_sentences():
    text = 'One two. "Three four?" Five!\nsix seven… Ende。ここ。'
    c = spans.cut(text)
    whole = [c.raw[c.at[a] : c.at[b]].decode().strip() for a, b in zip(c.starts[:-1], c.starts[1:], strict=True)]
    assert whole[:5] == ["One two.", '"Three four?"', "Five!", "six seven…", "Ende。"[:4] + "。"]
    long = spans.cut(" ".join(made(np.random.default_rng(2), 500)))
    assert np.diff(long.starts).max() <= spans.LIMIT and len(long.starts) > 60
    assert len(spans.cut(" \n").starts) == 1 and len(spans.cut(None).words) == 0 and len(spans.cut().words) == 0
    apart, both = [spans.cut(x) for x in ("a b c", text, None, "", text)], spans.cut("a b c", text, None, "", text)
    assert both.words.tolist() == [w for c in apart for w in c.words.tolist()] and np.diff(both.docs).tolist() == [len(c.words) for c in apart]
    assert np.diff(both.starts).tolist() == [n for c in apart for n in np.diff(c.starts).tolist()]


def test_hot_spans_and_reflowed_lines(spark, monkeypatch):
    """A passage that a third of all documents hold, and one whose lines break elsewhere."""
    monkeypatch.setattr(spans, "HOT", 0.0)
    r = np.random.default_rng(12)
    hot, other = made(r, 80), made(r, 60)
    docs = [(i, " ".join([*made(r, 20), *hot, *made(r, 20)])) for i in range(1500)]
    docs += [(2000, " ".join(other)), (2001, "\n".join(" ".join(other[k : k + 7]) for k in range(0, 60, 7)))]
    got = {d["doc_id"]: d["text"] for d in spans.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_spans(docs) and got[2001] == "" and len(got[7].split()) == 40


def test_multi_sequence_order():
    """The cells of least cost, in that order, up to the margin."""
    r = np.random.default_rng(5)
    x = r.normal(size=(40, 8))
    for margin in (0.0, 1.5, 1e9):
        index = vectors.Index(r.normal(size=(6, 4)), r.normal(size=(5, 4)), margin)
        row, left, right = index.traverse(x)
        for k, q in enumerate(x):
            cost = {(i, j): ((q[:4] - index.left[i]) ** 2).sum() + ((q[4:] - index.right[j]) ** 2).sum() for i in range(6) for j in range(5)}
            want = sorted((c for c in cost if cost[c] <= min(cost.values()) + margin + 1e-9), key=cost.get)
            assert [*zip(left[row == k].tolist(), right[row == k].tolist(), strict=True)] == want


def brute_vectors(x, threshold=0.9):
    ok = np.array([v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    wide = max((len(v) for v in x if v is not None), default=1)
    unit, size = np.zeros((len(x), wide)), np.array([0 if v is None else len(v) for v in x])
    for i in np.flatnonzero(ok):
        unit[i, : size[i]] = np.array(x[i], float) / np.linalg.norm(np.array(x[i], float))
    near = (unit @ unit.T >= threshold) & ok[:, None] & ok[None] & (size[:, None] == size[None])
    np.fill_diagonal(near, False)
    return near


def test_vector_links(spark):
    r = np.random.default_rng(6)
    centres = r.normal(size=(60, 16))
    x = [list(map(float, centres[i % 60] + r.normal(size=16) * r.choice([0.01, 0.25, 0.45]))) for i in range(1500)]
    x[1:40] = [x[0]] * 39  # a hot vector
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] * 16]
    rows = [(i, v, 1) for i, v in enumerate([*x, *bad])]
    out = vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, first int")).collect()
    near = brute_vectors([None if v is None else [None if c is None else np.float32(c) for c in v] for _, v, _ in rows])
    got = {r["vec_id"]: r for r in out}
    links = np.array([got[i]["n_links"] for i in range(len(rows))])
    assert len(out) == len(rows) and (links <= near.sum(1)).all() and links.sum() >= 0.9 * near.sum()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in range(1500, 1506)) and got[5]["component_id"] == 0 and not got[5]["kept"]
    want = components(len(rows), np.argwhere(near).tolist())
    assert np.mean([got[i]["component_id"] == want[i] for i in range(len(rows))]) > 0.9
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert [tuple(r) for r in vectors.near_duplicates(spark.createDataFrame([(1, None), (None, None)], "vec_id long, embedding array<float>")).orderBy("vec_id").collect()] == [(None, 0, None, False), (1, 0, 1, True)]


@pytest.mark.parametrize("block", [40, 16_384])
def test_vector_links_are_those_of_brute_force_in_one_cell_and_in_blocks(spark, monkeypatch, block):
    """Every length is searched; groups of many vectors are split; near vectors are all found."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = np.random.default_rng(11)
    centres = r.normal(size=(90, 8))
    x = [list(map(float, centres[i % 90] + r.normal(size=8) * 0.02)) for i in range(900)]
    x += [list(map(float, r.normal(size=3))) for _ in range(60)] + [[0.5, 1.0, 2.0]] * 2 + [[3.0]] * 3 + [[1.0, 2.0], [2.0, 4.0]]
    rows = [(i, v) for i, v in enumerate(x)]
    got = {d["vec_id"]: d for d in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    near = brute_vectors(x)
    assert [got[i]["n_links"] for i in range(len(x))] == near.sum(1).tolist()
    assert [got[i]["component_id"] for i in range(len(x))] == components(len(x), np.argwhere(near).tolist())


@pytest.mark.parametrize("name", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_tables(spark, name):
    """Of all links of brute force; the bound asked for is 0.9."""
    table = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet")
    rows = sorted((r["vec_id"], r["embedding"]) for r in table.select("vec_id", "embedding").collect())
    near = brute_vectors([None if v is None else [None if c is None else np.float32(c) for c in v] for _, v in rows])
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_duplicates(table).collect()}
    links = np.array([got[i] for i, _ in rows])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.98 * near.sum()


def test_rows_without_an_id(spark):
    rows = [(None, [1.0, 2.0]), (5, [1.0, 2.0]), (None, [9.0, 0.0]), (7, [2.0, 4.1])]
    got = sorted(map(str, vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert [g.split("(")[1] for g in got] == ["vec_id=5, n_links=2, component_id=5, kept=True)", "vec_id=7, n_links=2, component_id=5, kept=False)", "vec_id=None, n_links=0, component_id=None, kept=False)", "vec_id=None, n_links=2, component_id=5, kept=False)"]
