"""Every operator on a table of odd cases, against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest

from folia.llm import decontaminate, html_text, inner_product, katz, mixing, near_dup, sharding, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, slot string, shard string"


def _docs(spark, rows):
    """rows of (doc_id, text, source); three columns clash with result names."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], DOCS)


BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
ODD = [
    (1, " ".join(BASE), "a"), (2, " ".join(BASE), "b"), (3, " ".join(BASE[:-1] + ["other"]), None), (4, None, "a"), (5, "", None),
    (6, " \t\n ", "c"), (7, "One two", "c"), (8, "one TWO", "c"), (9, LONG, "c"), (10, LONG + " tail", "a"), (None, " ".join(BASE), "a"),
    (11, "same row twice here now", "b"), (11, "same row twice here now", "b"), (12, "ünïcode Ä ä É é", "ß"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return _docs(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return _docs(spark, [])


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sharding(odd, none):
    got = sharding.op1_sharding(odd).collect()
    assert len(got) == len(ODD) and sharding.op1_sharding(none).count() == 0
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sorted((r.doc_id or 0, r["size"], r.text_crc32) for r in got) == sorted((i or 0, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t, _ in ODD)


def test_sharding_balance_and_rebalance(spark, tmp_path):
    docs = _docs(spark, [(i, "x" * (i * 37 % 900), "s") for i in range(3000)])
    path = f"file://{tmp_path}/map"
    got = sharding.shard(docs, 16, path=path)
    by = [r["b"] for r in got.groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "b").collect()]
    assert len(by) == 16 and max(by) - min(by) <= 1000
    slotted = sharding.with_slots(docs)
    loads = sharding.slot_loads(slotted)
    first = sharding.load_map(spark, path)
    second = sharding.save_map(sharding.rebalance(first, loads, 17), path)
    assert {r.map_version for r in second.select("map_version").distinct().collect()} == {2}
    assert sharding.load_map(spark, path, 1).count() == sharding.N_SLOTS == second.count()
    old = {r.virtual_slot: r.shard for r in first.collect()}
    moved = [(r.virtual_slot, r.shard) for r in second.collect() if old[r.virtual_slot] != r.shard]
    assert sum(s == 16 for _, s in moved) >= 0.8 * len(moved) and len(moved) < 0.2 * sharding.N_SLOTS


def _targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        rest = [s for s in order if s not in full]
        t = {s: 2 * sizes[s] for s in full} | {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = {s for s in rest if t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mixing(spark, odd, none):
    sizes = Counter()
    for _, t, s in ODD:
        sizes[s] += len(_words(t))
    want = _targets(sizes)
    source = {(i, len(_words(t))): s for i, t, s in ODD}
    got = mixing.op3_mixing(odd).collect()
    assert len(got) == len(ODD) and mixing.op3_mixing(none).count() == 0 and mixing.mix(none).count() == 0
    for r in got:
        s = source[r.doc_id, r["size"]]
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-9, abs_tol=1e-9) and r.taken <= 2 * r["size"]
    assert sorted(map(str, got)) == sorted(map(str, mixing.op3_mixing(odd.repartition(3)).collect()))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert sum(len(_words(r.text)) for r in mixed.collect()) == sum(r.taken for r in got)
    many = _docs(spark, [(i, "w " * (1 + i % 50), "pqrst"[i % 5]) for i in range(4000)])
    taken, target = Counter(), {}
    for r in mixing.op3_mixing(many).collect():
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
    assert all(abs(taken[s] - target[s]) < 0.05 * target[s] for s in target)


def test_masks_hit_every_tolerated_window():
    from itertools import combinations

    for bad in combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.ENOUGH):
        assert any(
            all(p + k not in bad for k, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(decontaminate.WINDOW - len(m) + 1)
        )


def test_decontamination(spark, odd, none):
    items = [(1, " ".join(BASE[:16])), (2, "too short"), (3, None), (4, ""), (None, " ".join(f"n{k}" for k in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    changed = list(BASE[:16])
    changed[3], changed[9] = "xxx", "yyy"
    broken = [w if k % 3 else "zzz" for k, w in enumerate(BASE[:16])]
    docs = _docs(spark, [
        (20, "Intro words, " + "; ".join(changed).upper() + " end", "a"), (21, " ".join(broken), "a"), (22, "clean text only " * 30, "a"),
        (23, LONG + " " + " ".join(BASE[:16]), "a"), (24, " ".join(BASE[:6]), "a"), (None, " ".join(BASE[:16]), "a"),
    ])
    got = {(r.doc_id, r.item_id) for r in decontaminate.op4_decontamination(docs, bench).collect()}
    assert got == {(20, 1), (23, 1), (None, 1)}
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {21, 22, 24, None}
    assert decontaminate.clean(docs, bench).columns == ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
    assert decontaminate.op4_decontamination(none, bench).count() == 0
    assert decontaminate.op4_decontamination(odd, bench.limit(0)).count() == 0


def test_decontamination_verifies_every_diagonal(spark):
    a, b, c = ([f"{x}{k}" for k in range(n)] for x, n in (("a", 5), ("b", 5), ("c", 10)))
    items = [(k, " ".join(order)) for k, order in enumerate([[*a, *b, *a, *c], [*a, *b, *a, *b, *a, *c], [*b, *a, *c, *b, *a]])]
    bench = spark.createDataFrame([*items, (0, " ".join(f"n{k}" for k in range(25)))], "item_id long, text string").coalesce(1)
    other = "nothing of it " * 9
    docs = _docs(spark, [(30, " ".join([*a, *c]), "a"), (31, other, "a"), (31, " ".join([*a, *c]), "a"), (32, " ".join(f"n{k}" for k in range(25)), "a")])
    docs = docs.coalesce(1)
    got = {(r.doc_id, r.item_id): (r.matched, r.doc_start) for r in decontaminate.op4_decontamination(docs, bench).collect()}
    assert got == {(d, i): (15, 0) for d in (30, 31) for i in (0, 1, 2)} | {(32, 0): (25, 0)}
    assert [(r.doc_id, r.text) for r in decontaminate.clean(docs, bench).collect()] == [(31, other)]


def test_warc(spark):
    big, rows = "<p>" + "x" * 2000, []
    rows = [(1, "u1", big), (5, "u5", big), (3, None, big), (None, "un", big), (7, "u7", "small"), (8, "u8", "small"), (9, "u\r\n9", None), (9, "again", None), (10, "é", "é" * 600), (11, "e", "é" * 600), (12, "t", big + "y"), (12, "t", big + "y")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.op5_warc(pages).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    for h, ids in groups.items():
        mine = [r for r in got if r.payload_digest == hashlib.sha1(h.encode()).hexdigest()]
        assert sorted(map(str, (r.page_id for r in mine))) == sorted(map(str, ids))
        top = max(i for i in ids if i is not None)
        assert all(r.payload_bytes == len(h.encode()) for r in mine)
        if len(h.encode()) < 1000:
            assert all(r.record_type == "response" and r.refers_to is None for r in mine)
        else:
            assert [r.page_id for r in mine if r.record_type == "response"] == [top]
            assert all(r.refers_to == top for r in mine if r.record_type == "revisit")
    assert warc.op5_warc(pages.limit(0)).count() == 0


def test_warc_bytes_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "<p>é</p>"), (2, "http://a/y", "z" * 1500), (3, "http://a/z", "z" * 1500)], "page_id long, url string, html string")
    path = f"file://{tmp_path}/w"
    warc.write_archive(pages, path)
    for r in warc.read_warc(spark, path).collect():
        head, body = bytes(r.record).split(b"\r\n\r\n", 1)
        size = int(re.search(rb"Content-Length: (\d+)", head)[1])
        assert body[size:] == b"\r\n\r\n" and (size == 0) == (b"Type: revisit" in head)
    assert spark.read.parquet(f"{path}/payloads").count() == 2
    bad = spark.read.parquet(f"{path}/payloads").selectExpr("address", "cast('damaged' as binary) as payload").collect()
    spark.createDataFrame(bad, "address string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="no sound payload"):
        warc.read_pages(spark, path).collect()


def test_tokens(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokens.default_tokenizer())
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for i, t, _ in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), crc32(ids.tobytes())))
        start += len(ids)
    got = tokens.op6_tokens(odd).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokens.op6_tokens(none).count() == 0
    folder = f"file://{tmp_path}/t"
    files = tokens.write_tokens(odd, folder, tokens.default_tokenizer(), length=64, files=1)
    name = files.first()["name"]
    reader, index = tokens.open_tokens(folder, name)
    flat = np.concatenate([tokens.sequence(reader, k)[0] for k in range(-(-start // 64))])
    mask = np.concatenate([tokens.sequence(reader, k)[1] for k in range(-(-start // 64))])
    assert mask.sum() == start and mask[:start].all()
    for (_, at, n, crc), place in zip(want, index["at"].to_pylist(), strict=True):
        assert place == at and crc32(flat[at : at + n].astype("<u4").tobytes()) == crc


def test_pieces_encode_like_whole_texts():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(tokens.default_tokenizer()), tokens.Encoder(tokens.default_tokenizer())
    for text in ["It's 3.5% of   THE cost here", "á b ́c <|endoftext|> d", "tab\tline\r\nnext\x0bv\x0cf\x1cg", "日本語 テキスト", "don't  stop'll\n\n", "  lead", "Wörter%%% Ünd!?, A.b don't*** é&&& ÿ; ×÷% ß### 3%%% x's|"]:
        assert np.frombuffer(own(text), "<u4").tolist() == [*lib.encode(text, add_special_tokens=False).ids, 2]


def _components(rows, n, percent):
    sets = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i].append(frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = {i: i for i in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = list(parent)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in ids}


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"v{k}" for k in range(400)]
    rows = [(i, t) for i, t, _ in ODD if t is not LONG and (t or "")[:200] != LONG[:200]]
    rows += [(9, LONG[:20_000]), (10, LONG[:20_000] + " tail")]
    for g in range(40):
        text = rng.choice(vocabulary, int(rng.integers(5, 120))).tolist()
        for c in range(int(rng.integers(1, 7))):
            edited = list(text)
            for _ in range(int(rng.integers(0, 4))):
                edited[int(rng.integers(len(edited)))] = str(rng.choice(vocabulary))
            rows.append((100 + g * 10 + c, " ".join(edited)))
    docs = _docs(spark, [(i, t, "s") for i, t in rows])
    for n, got in ((4, near_dup.op7_near_dup(docs)), (5, near_dup.near_duplicates(docs, 5, 80))):
        got = got.collect()
        sets, want = _components(rows, n, 80)
        assert len(got) == len(rows)
        for r in got:
            assert r.n_shingles in {len(s) for s in sets[r.doc_id]}
            assert r.component_id == (None if r.doc_id is None else want[r.doc_id]) and r.kept == (r.doc_id == r.component_id)
    kept = near_dup.keep_one(docs, 4, 80)
    assert kept.columns == ["doc_id", *[c for c in docs.columns if c != "doc_id"]]
    want_ids = sorted(set(want_ for want_ in _components(rows, 4, 80)[1].values()))
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == want_ids and kept.filter("doc_id is null").count() == 1
    assert near_dup.op7_near_dup(none).count() == 0 and near_dup.keep_one(none).count() == 0


def test_near_duplicates_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 7)
    monkeypatch.setattr(near_dup, "REGION_SHINGLES", 300)
    rng = np.random.default_rng(5)
    text = [f"v{k}" for k in rng.integers(0, 300, 60)]
    rows = []
    for c in range(60):
        edited = list(text)
        for _ in range(int(rng.integers(0, 4))):
            edited[int(rng.integers(60))] = f"e{rng.integers(10**6)}"
        rows.append((c, " ".join(edited)))
    got = near_dup.op7_near_dup(_docs(spark, [(i, t, "s") for i, t in rows])).collect()
    want = _components(rows, 4, 80)[1]
    assert {r.doc_id: r.component_id for r in got} == want


def test_odd_sketch_estimates():
    rng = np.random.default_rng(1)
    for share in (0.95, 0.9, 0.8):
        unequal = []
        for _ in range(60):
            both = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
            extra = int(800 * (1 - share) / share / 2)
            a, b = (np.concatenate([both, rng.integers(0, 1 << 63, extra, dtype=np.uint64)]) for _ in range(2))
            o = near_dup.odd_sketches(np.stack([near_dup.samples(a), near_dup.samples(b)]))
            unequal.append(int(np.bitwise_count(o[0] ^ o[1]).sum()))
        assert abs(np.mean(unequal) - near_dup.most_unequal_bits(share)) < 6


PAGE = '<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li>Menu</li></ul></nav><div class="top-ad">Buy</div>%s<footer>&copy; f</footer></body></html>'


def test_html(spark):
    article = "<article><h1>Head&amp;line</h1><p><b>First\n  part<br>goes on<p>Second &eacute; &#x41;</p><div class='reader comments'><p>hi</p></div><aside>x</aside><form>f</form></article>"
    rows = [(1, "http://h/a/1", PAGE % article), (2, "http://h/a/2", None), (3, None, ""), (4, "http://k/p/1", "<div>Template top</div><div>Own text one</div><div>Template end"),
            (5, "http://k/p/2", "<div>Template top</div><div>Own text two</div><div>Template end"), (5, "http://k/p/2", "<div>Alone</div>"), (6, "http://z/1", "<p>copy</p>"), (None, "http://z/2", "<p>copy</p>"), (7, "http://[bad", "plain < text <unclosed")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in html_text.op8_html_text(pages).collect())
    first = "Head&line\n\nFirst part goes on\n\nSecond é A"
    assert ("1", "http://h/a/1", first, len(first)) in got and ("2", "http://h/a/2", "", 0) in got and ("3", None, "", 0) in got
    texts = {(i, t) for i, _, t, _ in got}
    assert {("4", "Own text one"), ("5", "Own text two"), ("6", "copy"), ("None", "copy"), ("5", "Alone")} <= texts
    assert len(got) == len(rows) and html_text.op8_html_text(pages.limit(0)).count() == 0


def test_html_differences_lines_beside_an_article(spark):
    page = "<article>Teaser %s</article><div>Follow us everywhere</div><div><p>Body of page %s, told at some length</p></div>"
    rows = [(k, f"http://h/a/{k}", page % (k, k)) for k in range(6)] + [(9, "http://m/1", "<main><nav>n</nav></main><div>Beside</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.op8_html_text(pages).collect()}
    assert got == {k: f"Teaser {k}\n\nBody of page {k}, told at some length" for k in range(6)} | {9: "Beside"}


def test_html_keeps_copies_and_passages(spark):
    body = [f"Paragraph {k} of a text that near copies share" for k in range(10)]
    near = ["".join(f"<p>{x if k != c else f'edited {c}'}</p>" for k, x in enumerate(body)) for c in range(6)]
    rows = [(k, f"http://copies/{k}", h) for k, h in enumerate(near)]
    quote = "<div>Menu of the host</div><p>%s</p><p>%s</p>"
    rows += [(100 + k, f"http://quotes/{k:02}", quote % ("A passage that two pages share" if k in (3, 4) else f"passage {k}", f"The own text of page {k}")) for k in range(12)]
    got = {r.page_id: r.text.split("\n\n") for r in html_text.op8_html_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[c] == [x if k != c else f"edited {c}" for k, x in enumerate(body)] for c in range(6))
    assert all(got[100 + k] == ["A passage that two pages share" if k in (3, 4) else f"passage {k}", f"The own text of page {k}"] for k in range(12))


@pytest.mark.parametrize("name", ["content with-sidebar", "no-sidebar", "search-result", "has-menu"])
def test_html_keeps_layout_classes(name):
    assert html_text.lines(f"<div class='{name}'><p>Text</p></div><div class='sidebar'>s</div><div id='top-ad'>a</div>") == [("Text", html_text.OPEN)]


@pytest.mark.parametrize("raw", ["<svg viewBox='0'/>", "<math/>", "<video src='v'>", "<object data='o'/>", "<video><video></video>", "<svg><path/></svg>", "<script>x</script>"])
def test_html_goes_on_after_raw_elements(raw):
    assert [x for x, _ in html_text.lines(f"<p>One</p>{raw}<p>Two</p>")] == ["One", "Two"]


def test_common_lines_is_longest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, 9).tolist(), rng.integers(0, 4, 8).tolist()
        best = np.zeros((10, 9), int)
        for i in range(9):
            for j in range(8):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert len(html_text.common_lines(a, b)) == best[9, 8]


def test_neighbours_across_pieces(spark):
    rows = [(i, f"u{i}", "big" if i % 3 else "small", f"/{i:04d}") for i in range(200)]
    keys = spark.createDataFrame([(i, i, h, p) for i, _, h, p in rows], "row long, page_id long, host string, path string")
    got = {r.row: (r.before, r.after) for r in html_text.neighbours(keys).collect()}
    for host in ("big", "small"):
        ids = [i for i, _, h, _ in rows if h == host]
        assert all(got[x] == (ids[k - 1] if k else None, ids[k + 1] if k + 1 < len(ids) else None) for k, x in enumerate(ids))


def test_inner_product(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.3, (400, 12)).astype("float32")
    base[100:220] = base[100]
    rows = [(i, x.tolist(), 1) for i, x in enumerate(base)]
    rows += [(1000, None, 1), (1050, [1.0, None], 1), (1100, [float("nan")] * 12, 0), (1150, [float("inf")] * 12, 0), (1200, [0.5] * 5, 0), (1250, [], 0), (None, [1.0] * 12, 0), (50, base[50].tolist(), 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    for frame, kw in ((inner_product.op9_inner_product(table), {}), (inner_product.top_k(v := inner_product.usable(table), v.filter("vec_id % 50 = 0"), 5, block=64, query_block=3), {})):
        got = defaultdict(dict)
        for r in frame.collect():
            got[r.query_id][r["rank"]] = (r.vec_id, r.score)
        whole = {}
        for i, x, _ in rows:
            if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x):
                whole[i] = np.r_[np.floor(256 * np.array(x, "float64")), np.zeros(12 - len(x))]
        for q in (i for i in whole if i % 50 == 0):
            best = sorted(((-int(whole[q] @ v), i) for i, v in whole.items() if i != q))[:5]
            assert got[q] == {k + 1: (i, -s) for k, (s, i) in enumerate(best)}
        assert set(got) == {i for i in whole if i % 50 == 0}
    assert inner_product.op9_inner_product(table.limit(0)).count() == 0


def test_toxicity(spark, none):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(900):
        words = [f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in rng.integers(0, 300, 40)]
        bad = i % 5 == 0
        if bad:
            words[3] = ("nastyish", "vilest")[i % 2]
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(bad)))
    rows += [(2000, None, "s"), (2001, "", "s"), (None, "nastyish", "s")]
    labels += [(None, 1, 1), (5, 1, None), (0, 0, 0)]
    docs, marks = _docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.op10_toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert held and all(r.predicted == (r.doc_id % 5 == 0) for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1) for r in got)
    assert not any(r.predicted for r in got if r.doc_id in (2000, 2001))
    assert toxicity.keep_clean(docs, marks).columns == docs.columns
    assert all(r.predicted == 0 for r in toxicity.op10_toxicity(docs, marks.limit(0)).collect())
    assert toxicity.op10_toxicity(none, marks).count() == 0


def test_machine_learns_a_pair():
    rng = np.random.default_rng(8)
    rows, y = [], []
    for k in range(2000):
        a, b = k % 2, k // 2 % 2
        rows.append(np.array(sorted({10 * (a + 1), 1000 * (b + 1), *rng.integers(5000, 5020, 3).tolist()})))
        y.append(int(a == b and rng.random() > 0.02))
    m = toxicity.fit(rows, np.array(y), seed=3, epochs=30)
    assert m.latent.shape[1] == toxicity.FACTORS


@pytest.mark.parametrize("noise", [3, 40])
def test_machine_tells_held_out_pairs(noise):
    rng = np.random.default_rng(8)
    rows, y = [], []
    for k in range(3000):
        a, b = k % 2, k // 2 % 2
        rows.append(np.array(sorted({10 * (a + 1), 1000 * (b + 1), *rng.integers(5000, 5400, noise).tolist()})))
        y.append(int(a == b))
    m, y = toxicity.fit(rows[:2000], np.array(y[:2000])), np.array(y[2000:])
    told = m.margins([m.places(r) for r in rows[2000:]]) > 0
    assert len(m.terms) == len(set(np.concatenate(rows[:2000]).tolist())) and (told == y).mean() > 0.95


def _katz(rows):
    """Plain Katz bigrams over dictionaries."""
    held = {k: katz.is_held(i) for k, (i, _) in enumerate(rows)}
    texts = [[*(t or "").encode().lower().split(), "<end>"] for _, t in rows]
    uni, bi = Counter(), Counter()
    for k, x in enumerate(texts):
        if not held[k]:
            uni.update(x)
            bi.update(zip(["<s>", *x], x, strict=False))
    n, v = sum(uni.values()), len(uni)
    stats = lambda c: [sum(c.values()), len(c), *(sum(x == r for x in c.values()) for r in range(1, katz.K + 2))]
    p1 = katz.Unigrams(stats(uni))
    d = katz.discounts(stats(bi)[2:])
    prob = lambda w: float(p1(np.array([uni[w]]))[0])
    after = defaultdict(dict)
    for (a, b), r in bi.items():
        after[a][b] = r

    def p(a, b):
        seen = after.get(a)
        if not seen:
            return prob(b)
        c = sum(seen.values())
        share = {w: float(katz.discounted(np.array([r]), d)[0]) / c for w, r in seen.items()}
        left, scale = 1 - sum(share.values()), 1.0
        if left < 1e-9:
            scale, left = c / (c + 1), 1 / (c + 1)
        return share[b] * scale if b in seen else left / (1 - sum(prob(w) for w in seen)) * prob(b)

    out = [(i, held[k], len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), sum(math.log10(p(a, b)) for a, b in zip(["<s>", *x], x, strict=False))) for k, ((i, _), x) in enumerate(zip(rows, texts, strict=True))]
    return out, p, uni, after


def test_katz(spark, odd, none, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, t) for i, t, _ in ODD if t is None or len(t) < 10_000]
    rows += [(100 + k, " ".join(f"t{int(x)}" for x in rng.zipf(1.6, 40) % 200)) for k in range(300)]
    rows += [(500 + k, "always same words " * 9) for k in range(4)]
    monkeypatch.setattr(katz, "TOKENS_A_BATCH", 900)
    got = katz.op2_katz(_docs(spark, [(i, t, "s") for i, t in rows])).collect()
    want, p, uni, after = _katz(rows)
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-6)
    for a in [*list(after)[:40], "<never>"]:
        assert math.isclose(sum(p(a, w) for w in uni) + p(a, "<unknown>"), 1, rel_tol=1e-9)
    assert katz.op2_katz(none).count() == 0
    assert all(r.score == 0 for r in katz.score(_docs(spark, [(1, "a b", "s")]), lambda i: True).collect())


def _katz_of_order(rows, order, is_held):
    """Plain Katz of any order over dictionaries: doc's log10 probability, and P(word | context)."""
    texts = [[*(t or "").encode().lower().split(), "<end>"] for _, t in rows]
    counts = [Counter() for _ in range(order + 1)]
    for (i, _), x in zip(rows, texts, strict=True):
        if not is_held(i):
            for at in range(len(x)):
                for k in range(1, order + 1):
                    if k - 1 <= at + 1:  # one mark of the start
                        counts[k][tuple(["<s>", *x][at + 2 - k : at + 2])] += 1
    # a context that reaches before the start is cut there
    for k in range(2, order + 1):
        for (i, _), x in zip(rows, texts, strict=True):
            if not is_held(i):
                for at in range(min(k - 2, len(x))):
                    counts[k][tuple(["<s>", *x][: at + 2])] += 1
    stats = [[sum(c.values()), len(c), *(sum(x == r for x in c.values()) for r in range(1, katz.K + 2))] for c in counts[1:]]
    p1, d = katz.Unigrams(stats[0]), [katz.discounts(s[2:]) for s in stats]
    after = [defaultdict(dict) for _ in range(order + 1)]
    for k in range(2, order + 1):
        for g, r in counts[k].items():
            after[k][g[:-1]][g[-1]] = r

    def p(context, w):
        """context: the words before w from the start mark on, or the last order - 1 of them."""
        return at_level(order, context, w)

    def at_level(k, context, w):
        if k == 1:
            return float(p1(np.array([counts[1][w,]]))[0])
        h = tuple(context[-(k - 1) :])
        seen = after[k].get(h)
        if not seen:
            return at_level(k - 1, context, w)
        c = sum(seen.values())
        share = {x: float(katz.discounted(np.array([r]), d[k - 1])[0]) / c for x, r in seen.items()}
        left, scale = 1 - sum(share.values()), 1.0
        if left < 1e-9:
            scale, left = c / (c + 1), 1 / (c + 1)
        if w in seen:
            return share[w] * scale
        return left / (1 - sum(at_level(k - 1, context, x) for x in seen)) * at_level(k - 1, context, w)

    out = [sum(math.log10(p(["<s>", *x][: at + 1], w)) for at, w in enumerate(x)) for x in texts]
    return out, p, [w for w, in counts[1]], after


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_of_any_order_and_from_its_tables(spark, monkeypatch, tmp_path, order):
    rng = np.random.default_rng(11)
    rows = [(k, " ".join(f"t{int(x)}" for x in rng.zipf(1.7, int(rng.integers(1, 30))) % 40)) for k in range(160)]
    rows += [(500 + k, "always same words " * 9) for k in range(4)] + [(600, None), (601, ""), (None, "t1 t2 t1")]
    monkeypatch.setattr(katz, "TOKENS_A_BATCH", 700)
    path = f"file://{tmp_path}/model"
    docs = _docs(spark, [(i, t, "s") for i, t in rows])
    got = {r.doc_id: r for r in katz.score(docs, katz.is_held, path, order).collect()}
    want, p, words, after = _katz_of_order(rows, order, katz.is_held)
    assert all(math.isclose(got[i].score, w, rel_tol=1e-6) for (i, _), w in zip(rows, want, strict=True))
    for h in [h for k in range(2, order + 1) for h in list(after[k])[:12]]:
        assert math.isclose(sum(p(list(h), w) for w in words) + p(list(h), "<unknown>"), 1, rel_tol=1e-9)
    # other documents, from the tables alone
    model = katz.load(spark, path)
    assert model.order == order and spark.read.parquet(f"{path}/grams/level={order}").filter("kind = 'model'").select("range").distinct().count() > 1
    others = [(k, t if k % 2 else f"{t} never seen t3") for k, (_, t) in enumerate(rows)]
    again = {r.doc_id: r for r in katz.score_with(_docs(spark, [(i, t, "s") for i, t in others]), model).collect()}
    train = [(10_000 + k, t) for k, (i, t) in enumerate(rows) if not katz.is_held(i)]
    want, *_ = _katz_of_order(train + others, order, lambda i: i is not None and i < 10_000)
    assert all(math.isclose(again[i].score, w, rel_tol=1e-6) and again[i].held_out for (i, _), w in zip(others, want[len(train) :], strict=True))
    assert katz.score_with(docs.limit(0), model).count() == 0


def _main_texts(rows):
    """Plain differencing over (page_id, url, html): page_id to blocks. Lines of a page differ from each other."""
    from urllib.parse import urlsplit

    hosts = defaultdict(list)
    for i, url, html in rows:
        hosts[urlsplit(url).netloc].append((urlsplit(url).path, i, html_text.marked_lines(html)))
    out = {}
    for host in hosts.values():
        host.sort()
        heads, shared = [], {}
        for k, (_, i, own) in enumerate(host):
            texts = [x for x, _ in own]
            near = [host[j][2] for j in (k - 1, k + 1) if 0 <= j < len(host)]
            common = [html_text.common_lines(texts, [x for x, _ in n]) for n in near]  # of the longest there are several
            shared[i] = {texts[p] for c in common for p in c if own[p][1] != html_text.ARTICLE}
            size = lambda n: sum(len(x) for x, kind in n if kind != html_text.BOILER)
            if k == 0 or sum(len(texts[p]) for p in common[0] if own[p][1] != html_text.BOILER) < 0.8 * max(size(own), size(near[0]), 1):
                heads.append(own)
        count = Counter(x for own in heads for x in {x for x, kind in own if kind != html_text.ARTICLE})
        enough = max(2, min(5, math.ceil(len(heads) / 2)))
        for _, i, own in host:
            text = [(x, kind) for x, kind in own if kind != html_text.BOILER]
            left = [x for x, kind in text if kind == html_text.ARTICLE or not (x in shared[i] and count[x] >= enough)]
            out[i] = left or [x for x, _ in text]
    return out


def test_html_like_plain_differencing(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(150):
        pick = lambda n, size, word: [f"{word} {k}" for k in rng.permutation(size)[:n]]
        own = [f"own {i} {k} " + "x" * int(rng.integers(0, 60)) for k in range(int(rng.integers(0, 4)))]
        parts = [f"<div>{x}</div>" for x in pick(3, 5, "template")] + [f"<nav>{x}</nav>" for x in pick(1, 5, "template")] + [f"<p>{x}</p>" for x in own + pick(1, 30, "passage")]
        if i % 4 == 0:
            parts.append(f"<article><p>{rng.choice(['template 1', 'article'])}</p><p>body {i}</p></article>")
        rows.append((i, f"http://h{i % 3}.org/{int(rng.integers(0, 40)):03d}/{i:03d}", "".join(parts)))
        if i % 10 == 0:
            rows.append((1000 + i, f"{rows[-1][1]}x", rows[-1][2].replace("own", "own", 1)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text.split("\n\n") if r.text else []) for r in html_text.op8_html_text(pages).collect()}
    want = _main_texts(rows)
    assert got == want
    assert sum(len(html_text.lines(h)) for _, _, h in rows) > sum(map(len, want.values()))  # differencing did delete lines
    counted = {r.kind: (r.lines, r.shared) for r in html_text.decisions(pages).collect()}
    kinds = Counter(k for _, _, h in rows for _, k in html_text.marked_lines(h))
    assert {k: n for k, (n, _) in counted.items()} == {"article": kinds[html_text.ARTICLE], "open": kinds[html_text.OPEN], "boiler": kinds[html_text.BOILER]}
    assert all(0 < s <= n for n, s in counted.values())


@pytest.mark.parametrize(("html", "text"), [
    ("<div class='has-sidebar'><article><p>A</p></article></div>", ["A"]), ("<main></main><article><p>A</p></article>", ["A"]),
    ("<article><p>A</p><div id='search-history'><p>B</p></div><div class='ad-free'>C</div></article>", ["A", "B", "C"]),
    ("<p>if x<y z then</p><p>1 < 2 <b>c</b></p>", ["if x<y z then", "1 < 2 c"]), ("<p>a <span hidden>b</span> c</p>", ["a c"]),
])
def test_html_reads_odd_pages(html, text):
    assert [x for x, _ in html_text.lines(html)] == text


def _overlaps(docs, items):
    """Every diagonal of every document and item by brute force: (doc_id, item_id) to matched, aligned, best, start."""
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = {}
    for d, text in docs:
        a = cut(text)
        for i, item in items:
            b = cut(item)
            if len(b) < 5:
                continue
            for start in range(1 - len(b), len(a)):
                same = [int(a[start + k] == b[k]) for k in range(len(b)) if 0 <= start + k < len(a)]
                best = max((sum(same[k : k + 13]) for k in range(len(same))), default=0)
                if best >= decontaminate.needed(len(b)):
                    out[d, i] = max(out.get((d, i), ()), (sum(same), len(same), best, -max(start, 0)))
    return out


@pytest.mark.parametrize("most", [10, 1_000_000])
def test_decontamination_like_every_diagonal(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST_SEEDS", most)
    rng = np.random.default_rng(21)
    words = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(words, int(rng.integers(2, 40))))) for k in range(30)] + [(77, "w1 w2 w3 w4 w1 w2 w3 w4 w1 w2 w3 w4 w1 w2 w3 w4")]
    items += [(78, "s1 s2 s3 s4 s5"), (79, "s1 s2 s3 s4 s5 s6 s7"), (80, "s1 s2 s3 s4"), (81, "")]
    docs = [(900, "a s1 s2 s3 s4 s5 b"), (901, "s1, s2, s3, S4, s5; s6 s7"), (902, "s1 s2 s3 x s5 s6 s7"), (903, None)]
    for k in range(150):
        body = rng.choice(words, int(rng.integers(0, 50))).tolist()
        if k % 2:
            part = items[int(rng.integers(len(items)))][1].split()
            part = part[int(rng.integers(0, 1 + len(part) // 3)) :]
            for _ in range(int(rng.integers(0, 4))):
                if part:
                    part[int(rng.integers(len(part)))] = "changed"
            at = int(rng.integers(len(body) + 1))
            body = body[:at] + part + body[at:]
        docs.append((k, ", ".join(body)))
    got = decontaminate.op4_decontamination(_docs(spark, [(i, t, "s") for i, t in docs]), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = _overlaps(docs, items)
    assert {(r.doc_id, r.item_id): (r.matched, r.aligned, r.best_window, -r.doc_start) for r in got} == want
    assert {(d, i) for d, i in want if i >= 78 and d >= 900} == {(900, 78), (901, 78), (901, 79)} and len(want) > 40


def test_inner_product_leaves_whole_blocks_out(spark):
    rows = [(b, float(100 - 10 * b)) for b in range(1, 9)]
    longest = spark.createDataFrame(rows, "block int, longest double")
    queries = spark.createDataFrame([(0, 65.0), (0, 70.0), (1, float("-inf")), (2, 1000.0)], "q_block int, needed double")
    got = {(r.block, r.q_block) for r in inner_product.block_pairs(longest, queries).collect()}
    assert got == {(b, 0) for b, n in rows if n >= 65} | {(b, 1) for b, _ in rows}
    # vectors of falling length: the short ones meet no query, and the result is whole
    rng = np.random.default_rng(14)
    base = rng.normal(0, 1, (600, 8)) * np.geomspace(1, 0.001, 600)[:, None]
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(base)], "vec_id long, embedding array<double>")
    v = inner_product.usable(table)
    got = {(r.query_id, r["rank"]): r.score for r in inner_product.top_k(v, v.filter("vec_id % 50 = 0"), 5, block=40, query_block=3).collect()}
    whole = np.floor(256 * base)
    for q in range(0, 600, 50):
        best = sorted((int(whole[q] @ whole[i]) for i in range(600) if i != q), reverse=True)[:5]
        assert [got[q, k + 1] for k in range(5)] == best


def test_intermediate_tables_can_be_cleared(spark):
    from folia.llm import common

    kept = common.stored(spark.range(3), "some")
    assert kept.count() == 3 and common.new_path(spark, "x").count(spark.sparkContext.applicationId) == 1
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{common.shared_dir(spark)}/folia/{spark.sparkContext.applicationId}")
    assert folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    common.clear(spark)
    assert not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
