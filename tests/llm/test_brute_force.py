"""Operators against plain Python on small tables, edge cases included."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from basketloom.llm import (
    chat_format,
    decontaminate,
    dom,
    html_extract,
    jaccard_join,
    pii,
    quality_rules,
    repeats,
)
from basketloom.llm.run_length_index import RunLengthIndex, repeated_windows

SYLLABLES = "ka lo mi re tu shi no va".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# decontamination


def brute_contamination(text, items, window=13):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall((text or "").encode().lower())
    hit, found = set(), set()
    for item, said in items:
        item_words = word.findall((said or "").encode().lower())
        m = min(window, len(item_words))
        patterns = {tuple(item_words[k : k + m]) for k in range(len(item_words) - m + 1)} if m else set()
        for k in range(len(words) - m + 1):
            if tuple(words[k : k + m]) in patterns:
                hit.update(range(k, k + m))
                found.add(item)
    return len(words), len(hit), found


@pytest.mark.parametrize("block_chars", [10**6, 60])
def test_contamination(spark, documents, edge_rows, block_chars, monkeypatch):
    monkeypatch.setattr(decontaminate, "CHUNK_BYTES", 200)
    rng = random.Random(1)
    items = [(k, prose(rng, n)) for k, n in enumerate((3, 13, 20, 1, 40, 13))]
    items += [(6, None), (7, ""), (8, "tie"), (9, items[1][1]), (2, prose(rng, 15))]
    rows = list(edge_rows)
    for k in range(20, 40):
        parts = [prose(rng, rng.randint(0, 40)), rng.choice(items)[1] or "", prose(rng, 30)]
        rows.append((k, " ".join(parts).upper() if k % 2 else ", ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.verdict(
        decontaminate.find_contamination(documents(rows), bench, block_chars=block_chars)
    ).collect()
    assert len(found) == len(rows)
    for r in found:
        n, hit, ids = brute_contamination(r["text"], items)
        assert (r["n_words"], r["n_hit"], set(r["item_ids"])) == (n, hit, ids), r["doc_id"]
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_contamination_of_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontaminate.find_contamination(documents([(1, "a b")]), bench).collect()
    assert rows[0]["n_words"] == 2 and rows[0]["spans"] == []
    assert decontaminate.find_contamination(documents([]), bench).count() == 0


# HTML


@pytest.mark.parametrize("n", [19_000, 20_001, 1_000_000])
def test_quoted_values_of_any_length(n):
    said = prose(random.Random(12), 60)
    for sign, other in (('"', "'"), ("'", '"')):
        value = (f"a>b <p class={other}ad hidden{other}> hidden " * (n // 20))[:n]
        page = f"<body><article><p title={sign}{value}{sign} class='text'>{said}</p></article></body>"
        assert html_extract.main_text(page, frozenset()) == said
    # a quote that is never closed is none, and is not searched for again at every tag
    assert [t for _, t in dom.read_page("<p a='x>one</p><p>two</p>").blocks] == ["one", "two"]
    assert len(dom.read_page("<p>x</p>" * (n // 8) + "<p a='x>one</p><p b=\"y>two</p>" * 1).blocks) > n // 8


@pytest.mark.parametrize("depth", [400, 600, 20_000])
def test_pages_of_any_depth_are_read_whole(depth):
    for tag in ("div", "span", "b"):
        inner = f"<{tag}>" * depth + "<p>deep</p>" + f"</{tag}>" * depth
        page = f"<div><article><p>head</p>{inner}<p>tail</p></article></div><footer>f</footer>"
        assert html_extract.main_text(page, frozenset()) == "head\ndeep\ntail"


def test_formulas_stand_in_their_line():
    page = "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be z.</p></article>"
    assert html_extract.main_text(page, frozenset()) == "Let x=1 be z."


def test_main_text_of_mixed_markup():
    page = (
        '<html><body class="home"><header><h1>Site</h1></header><div id="sidebar"><p>side</p></div>'
        '<main><article><header><h1>T &amp; x</h1></header><p title="a > b">Hello <b>wo</b>rld &lt;3'
        '<p>two<br>lines</p><div class="comments"><article class="comment"><p>bad</p></article></div>'
        "<form><p>f</p></form><ul><li>one<li>two</ul>1 < 2 <!-- no --><script>x</scr</script>"
        "</article></main><footer>f</footer>"
    )
    expected = "T & x\nHello world <3\ntwo lines\none\ntwo\n1 < 2"
    assert html_extract.main_text(page, frozenset()) == expected


def test_site_tree_removes_what_every_page_repeats(spark):
    def page(k, of_site):
        body = f"<h2>Title {k}</h2><div>Body of page {k}</div>"
        return f"<body><div><span>{of_site}</span></div>{body}</body>"

    rows = [(k, f"http://a.example/{k}", page(k, "Daily news of the town")) for k in range(9)]
    rows += [(20, "http://b.example/1", page(20, "Daily news of the town"))]
    rows += [(21, None, None), (22, "nowhere", ""), (23, "http://a.example/0", rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_main_text(pages).collect()}
    assert len(got) == len(rows)
    for k in range(9):
        assert got[k] == f"Title {k}\nBody of page {k}"
    # one page of a site says nothing about what the site repeats
    assert got[20] == "Daily news of the town\nTitle 20\nBody of page 20"
    assert got[21] == got[22] == "" and got[23] == got[0]


def test_joining_by_host_gives_the_same(spark, monkeypatch):
    rows = [(k, f"http://a.example/{k}", f"<div><i>same</i></div><p>own {k}</p>") for k in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    sent = sorted(html_extract.extract_main_text(pages).collect())
    monkeypatch.setattr(html_extract, "SENT_ELEMENTS", -1)
    assert sorted(html_extract.extract_main_text(pages).collect()) == sent


# repeats


def brute_repeats(rows, length=100):
    """Rows in their order: missing ids first."""
    seen, out = set(), []
    for raw in rows:
        covered = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            window = raw[k : k + length]
            if window in seen:
                covered[k : k + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out.append((len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group_pieces", [1000, 2])
def test_repeats(documents, group_pieces, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_PIECES", group_pieces)
    rng = random.Random(2)
    passage, other = prose(rng, 60), prose(rng, 25)
    rows = [(None, None), (0, ""), (1, "x" * 350), (2, None)]
    for k in range(3, 30):
        parts = [prose(rng, rng.randint(0, 30)), passage, prose(rng, 9), other, "é" * rng.randint(0, 120)]
        rows.append((k, " ".join(parts[: rng.randint(1, 5)])))
    rows += [(30, rows[5][1]), (31, rows[5][1][:-3] + "q")]
    got = by_id(repeats.remove_repeats(documents(rows)).collect())
    for (doc_id, _), expected in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]), strict=True):
        r = got[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == expected, doc_id


def test_repeats_of_rows_that_share_an_id(documents):
    text = prose(random.Random(3), 60)
    got = repeats.remove_repeats(documents([(1, text), (1, text), (1, "short"), (0, None)])).collect()
    removed = sorted((r["doc_id"], r["n_removed"]) for r in got)
    assert removed == [(0, 0), (1, 0), (1, 0), (1, len(text))]
    assert repeats.remove_repeats(documents([])).count() == 0


def test_run_length_index():
    rng = np.random.default_rng(4)
    for _ in range(40):
        length = int(rng.integers(3, 12))
        base = rng.integers(97, 100, 60).astype(np.uint8).tobytes()
        pieces = []
        for _ in range(int(rng.integers(1, 25))):
            a = int(rng.integers(0, 40))
            piece = bytearray(base[a : a + int(rng.integers(0, 40))])
            if piece and rng.random() < 0.5:
                piece[int(rng.integers(0, len(piece)))] = int(rng.integers(0, 256))
            pieces.append(bytes(piece))
        order = rng.permutation(len(pieces)) * 1000
        first = {}
        for k in np.argsort(order):
            for s in range(len(pieces[k]) - length + 1):
                first.setdefault(pieces[k][s : s + length], order[k] + s)
        got = repeated_windows(pieces, order, length)
        for k, piece in enumerate(pieces):
            expected = [
                s for s in range(len(piece) - length + 1) if first[piece[s : s + length]] != order[k] + s
            ]
            assert list(got[k]) == expected


def test_repetitive_text_has_few_runs():
    index = RunLengthIndex([b"abracadabra, said the cat " * 40])
    assert index.runs < 60


# quality rules


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {p for k, w in enumerate(windows) if windows.count(w) > 1 for p in range(k, k + 3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(inside),
    )


@pytest.mark.parametrize("few", [32, 0])
def test_quality_statistics(documents, edge_rows, few, monkeypatch):
    monkeypatch.setattr(quality_rules, "FEW_WINDOWS", few)
    rng = random.Random(5)
    rows = list(edge_rows)
    for k in range(20, 32):
        text = prose(rng, rng.randint(0, 150))
        rows.append((k, (text + "\n" + text[:80] + " # é|\t\x0b \n") * rng.randint(1, 3)))
    judged = quality_rules.judge_quality(documents(rows), carry=["doc_id", "text"]).collect()
    assert len(judged) == len(rows)
    for r in judged:
        expected = brute_statistics(r["text"])
        assert tuple(r[c] for c in quality_rules.STATISTICS) == expected, r["doc_id"]
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_of_no_documents(documents):
    assert quality_rules.judge_quality(documents([]), carry=["doc_id"]).count() == 0


# Jaccard join


def brute_components(rows, size=4, percent=85):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = [tuple(words[k : k + size]) for k in range(len(words) - size + 1)]
        sets.append(set(grams) or ({tuple(words)} if words else set()))
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    ids: dict = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            ids[root(k)] = min(doc_id, ids.get(root(k), doc_id))
    return sorted(
        ((doc_id, len(sets[k]), ids.get(root(k))) for k, (doc_id, _) in enumerate(rows)), key=str
    )


@pytest.mark.parametrize(
    ("frequent", "large", "block"), [(64, 2000, 3), (1, 2000, 4096), (1, 60, 2)]
)
def test_jaccard_components(documents, frequent, large, block, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "LARGE_SET", large)
    # buckets of several components are paired up block by block
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard_join, "LOCAL_COUNT", 1)
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, "a b"), (3, "A b"), (4, "a b c"), (None, "a B"), (2, "other words")]
    bases = [prose(rng, n).split() for n in (12, 30, 90, 90)]
    for k in range(10, 70):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(SYLLABLES)
        rows.append((k, " ".join(words)))
    got = jaccard_join.jaccard_components(documents(rows)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_jaccard_components_of_five_words_and_eighty_percent(documents, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    monkeypatch.setattr(jaccard_join, "LOCAL_COUNT", 1)
    rng = random.Random(16)
    rows = []
    # sets about the sizes where frequent tokens are indexed singly or in pairs
    bases = [prose(rng, n).split() for n in (20, 22, 24, 25, 26, 30, 60)]
    for k in range(90):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(len(words))] = rng.choice(SYLLABLES)
        rows.append((k, " ".join(words[: len(words) - rng.randint(0, 5)])))
    got = jaccard_join.jaccard_components(documents(rows), size=5, percent=80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, 5, 80)


@pytest.mark.parametrize("cut", [1, 2, 5, 100])
def test_tokens_are_counted_whatever_the_batches(cut):
    rng = random.Random(3)
    tokens = sorted(rng.choice([1, 2, 3, 3, 3, 3, 3, 4, 5, 6, 7, 8, 9]) for _ in range(60)) + [10]
    rows = pa.RecordBatch.from_pydict({"rep": list(range(61)), "token": tokens})
    batches = (rows.slice(k, cut) for k in range(0, 61, cut))
    got = pa.Table.from_batches(list(jaccard_join._shared_tokens(4)(batches))).to_pylist()
    counts = Counter(tokens)
    want = [(k, t) for k, t in enumerate(tokens) if counts[t] > 1]
    assert [(r["rep"], r["token"]) for r in got] == want
    assert all(min(r["count"], 5) == min(counts[r["token"]], 5) for r in got)


def test_likely_pairs_of_one_cell(monkeypatch):
    monkeypatch.setattr(jaccard_join, "PAIRED_BUCKET", 5)
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 800, dtype=np.uint64)
    rows, sets = [], []
    # about the size where sketches double, so that long ones are folded
    for rep in range(40):
        mine = np.append(base[: rng.integers(320, 380)], rng.integers(0, 2**63, rep, dtype=np.uint64))
        mine = np.append(mine, base[500 : 500 + 10 * (rep % 3)])
        bits = np.zeros(64 * jaccard_join.sketch_words(len(mine)), np.uint8)
        bits[(mine >> np.uint64(32)) % np.uint64(len(bits))] = 1
        sets.append(set(mine.tolist()))
        rows.append(
            {
                "cell": rep // 20, "bucket": rep // 20, "rep": rep, "n": len(mine), "component": rep // 2,
                "block": rep % 2, "cross": rep >= 20, "buckets": [7, rep // 20],
                "sketch": np.packbits(bits).view(np.int64).tolist(),
            }
        )
    batch = pa.RecordBatch.from_pylist(rows)
    got = pa.Table.from_batches(list(jaccard_join._cross_pairs(85)([batch]))).to_pylist()
    found = {(r["a"], r["b"]) for r in got}
    assert len(found) == len(got) and all(r["n_a"] == len(sets[r["a"]]) for r in got)
    linked = {
        (a, b)
        for b in range(40)
        for a in range(b)
        if a // 20 == b // 20 and a // 2 != b // 2 and (b < 20 or a % 2 != b % 2)
        and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    }
    assert linked and linked <= found


def test_pair_leaves_though_the_carried_buckets_are_not_shared():
    row = {"cell": 1, "bucket": 5, "n": 3, "block": 0, "cross": False, "sketch": [7] * 8}
    rows = [row | {"rep": 0, "component": 0, "buckets": [1, 2]}, row | {"rep": 1, "component": 1, "buckets": [3, 4]}]
    got = pa.Table.from_batches(list(jaccard_join._cross_pairs(85)([pa.RecordBatch.from_pylist(rows)]))).to_pylist()
    assert got == [{"a": 0, "b": 1, "n_a": 3, "n_b": 3}]
    # a smaller bucket that both carry is where the pair leaves
    rows[1]["buckets"] = [2, 5]
    assert not list(jaccard_join._cross_pairs(85)([pa.RecordBatch.from_pylist(rows)]))


def test_jaccard_components_leave_small_tables(documents, tmp_path, monkeypatch):
    monkeypatch.setattr("basketloom.runtime.checkpoint_root", lambda spark: f"file://{tmp_path}")
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(999)) for _ in range(300))) for k in range(40)]
    got = jaccard_join.jaccard_components(documents(rows))
    # fronts and sketches of the texts are not held until the result is read
    left = [spark_table for spark_table in tmp_path.glob("basketloom/jaccard-*/*") if any(spark_table.iterdir())]
    columns = {c for path in left for c in pq.read_table(path).column_names}
    assert got.count() == 40 and left and not columns & {"front", "sketch", "tokens"}


def test_jaccard_components_of_no_documents(documents):
    assert jaccard_join.jaccard_components(documents([])).count() == 0


# chat


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "user", "a ### b \\ </turn>\n### user: "),
        (1, 1, "assistant", "\\### Assistant: </turn> ok"),
        (1, 2, "assistant", "######## \\\\# <</turn>"),
        (2, 0, None, None),
        (2, 0, "a:\\: b\n", "é"),
        (None, None, "assistant", ""),
        (2, 0, "a:\\: b\n", "é"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chat(table)).collect()}
    assert set(got) == {1, 2, None}
    for conv_id in got:
        mine = sorted(
            (r for r in rows if r[0] == conv_id), key=lambda r: (r[1] or 0, r[2] or "", r[3] or "")
        )
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in mine)
        learned = "".join(t or "" for _, _, r, t in mine if r == "assistant")
        assert got[conv_id]["n_turns"] == len(mine)
        assert got[conv_id]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[conv_id]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert got[conv_id]["loss_chars"] == len(learned)
    assert chat_format.format_chat(table.limit(0)).count() == 0


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    def luhn(digits):
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return sum(x - 9 * (x > 9) for x in doubled) % 10 == 0

    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]()
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [f"{kind}:{start}:{end}" for start, _, end, kind in sorted(out)]


def test_base_spans(documents, edge_rows):
    rng = random.Random(7)
    pieces = [
        "a@b.c_d@e.f.g", "x.y+z%@ex-ample.org.", "é1.2.3.4.5", "999.1.1.1.1", "0001.002.3.255",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "1" * 30, "+1 (524) 555-7373", "+12", "++49 30 901820",
        "+1.", "@@", "a@b", "1.2.3", "00000000000000", "é", "\n", "word",
    ]
    rows = list(edge_rows) + [(30, "7 " * 9000), (31, "1.2.3.4 " * 700), (32, "a" * 50_000 + "@")]
    for k in range(40, 80):
        rows.append((k, rng.choice([" ", "", ", "]).join(rng.choices(pieces, k=rng.randint(1, 9)))))
    got = pii.find_personal_data(documents(rows), carry=["doc_id", "text"]).select(
        "text", pii.spans_text("base").alias("base")
    )
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["base"] == ",".join(brute_spans(r["text"])), r["text"][:80]


def test_addresses_with_zero_parts(documents):
    said = ["10.0.0.1", "0.0.0.0", "000.1.2.3", "1.2.3.256", "192.168.0.1", "1.2.3.0", "0256.1.1.1",
            "100.200.010.0", "1.2.3.00", "300.0.0.0", "255.0255.249.199"]
    rows = [(k, f"x {ip} y") for k, ip in enumerate(said)]
    got = by_id(pii.find_personal_data(documents(rows)).select("doc_id", pii.spans_text("base").alias("base")).collect())
    for k, text in rows:
        assert got[k]["base"] == ",".join(brute_spans(text)), text
    assert [k for k, _ in rows if not got[k]["base"]] == [3, 6, 9]


def test_trusted_patterns_find_unseen_identifiers(documents):
    rows = [(k, f"Hello there my mail: user{k}{k}@mail.example and more") for k in range(6)]
    rows += [(10, "Hello there my mail: 55512345(at)mail"), (11, "sold 1234567 units of my mail: x")]
    rows += [(12, "the order 7654321 went out"), (13, "write 55512345(at)mail now")]
    found = by_id(pii.find_personal_data(documents(rows)).collect())
    assert [s["kind"] for s in found[10]["spans"]] == ["other"]
    start, end, _ = found[10]["spans"][0]
    assert rows[6][1][start:end] == "55512345(at)mail"
    assert found[11]["spans"] == found[12]["spans"] == []
    # a known identifier is found wherever it stands
    assert len(found[13]["spans"]) == 1


def test_patterns_before_long_blanks_and_glued_marks(documents):
    cases = [
        (lambda v: f"Hello my{' ' * 90}mail:\n{v} and more", 0),
        (lambda v: f"Hello see {'long' * 700} at {v} and more", 0),
        (lambda v: f"Hello write to <{v}> and more", 1),
        (lambda v: f"Hello reach them TEL:{v} and more", 4),
        (lambda v: f"Hello ask for (mail={v}) and more", 6),
    ]
    for said, glued in cases:
        rows = [(k, said(f"user{k}{k}@mail.example")) for k in range(5)] + [(10, said("1234567-ab"))]
        # the same two words before other marks do not count against a pattern with a mark
        rows += [(k, said("none").replace("<", "").replace("TEL:", "").replace("(mail=", "")) for k in range(20, 40)] * (glued > 0)
        found = by_id(pii.find_personal_data(documents(rows)).collect())
        text = dict(rows)[10]
        assert [text[s["start"] : s["end"]] for s in found[10]["spans"]] == ["1234567-ab"], text[:60]


def test_scoring_goes_on_until_nothing_is_added(documents):
    rows, n = [], 0
    number = lambda step, k: f"{step}{k}77{step}{k}99"
    for step in range(7):
        for k in range(4):
            # what one pattern introduces is what makes the next one trusted
            value = f"user{k}@mail.example" if step == 0 else number(step, k)
            rows += [(n, f"note first{step} second{step} {value} end"), (n + 1, f"note first{step} second{step} {number(step + 1, k)} end")]
            n += 2
    found = by_id(pii.find_personal_data(documents(rows)).collect())
    assert all(len(found[i]["spans"]) == 1 for i, _ in rows)


def test_redaction(spark):
    table = spark.createDataFrame(
        [("é a@b.c, 1.2.3.4!", [(2, 7, "email"), (9, 16, "ip")]), ("+1 2", [(0, 4, "card"), (1, 3, "ip")]),
         ("none", []), (None, [])],
        "text string, spans array<struct<start:int,end:int,kind:string>>",
    )
    got = [r[0] for r in table.select(pii.redact(table.text, table.spans)).collect()]
    assert got == ["é <EMAIL>, <IP>!", "<CARD>", "none", ""]
