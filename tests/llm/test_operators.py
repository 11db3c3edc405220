"""Each corpus operator against a plain version, on awkward documents and on the smallest tables."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larder.llm import chat, common, decontaminate, html, jaccard, linededup, lm, packing, passages, quality, queries, substring, toxicity

from . import brute

SF = "/root/testdata/sf0.001"


def table(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet")


def texts(spark):
    return [(r[0], r[1]) for r in table(spark, "documents").select("doc_id", "text").collect()]


def same(df, want):
    got = sorted(map(tuple, df.collect()), key=repr)
    want = sorted(map(tuple, want), key=repr)
    assert len(got) == len(want)
    assert got == want


# --- quality ---


def test_quality_measures(odd, odd_frame, none):
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    same(quality.apply_rules(odd_frame).select(*cols), [(i, *brute.quality(t)) for i, t in odd])
    assert quality.apply_rules(none).count() == 0


def test_quality_verdict_follows_the_table(spark, odd_frame):
    out = quality.apply_rules(odd_frame).select("base_failed", "broken", "kept").collect()
    assert all(r["kept"] == (not r["base_failed"] and not r["broken"]) for r in out)
    assert quality.apply_rules(odd_frame, rules=()).where("kept <> (NOT base_failed)").count() == 0
    plan = quality.apply_rules(odd_frame)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40), min_size=1, max_size=8))
def test_repeat_words(spark, docs):
    rows = [(i, " ".join(d)) for i, d in enumerate(docs)]
    same(quality.apply_rules(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_repeat_words"), [(i, brute.quality(t)[4]) for i, t in rows])


# --- language model ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.integers(0, 1 << 41))
def test_elias_fano(values, probe):
    v = np.array(sorted(values), np.uint64)
    ef = lm.EliasFano(lm.encode(v, (1 << 41) + 1))
    if len(v):
        assert (ef.access(np.arange(len(v))) == v).all()
    x = np.array([probe, *values[:20]], np.uint64)
    at, found = ef.successor(x)
    want = np.searchsorted(v, x)
    assert (found == np.isin(x, v)).all() and (at[found] == want[found]).all()


@pytest.mark.parametrize("top", [5, 1 << 20, 1 << 40])
def test_distinct_pairs(top):
    r = np.random.default_rng(3)
    a, b = r.integers(0, top, 400), r.integers(0, 7, 400)
    a[200:], b[200:] = a[:200], b[:200]
    high, low, back = lm.distinct(a, b)
    assert sorted(set(zip(a.tolist(), b.tolist(), strict=True))) == list(zip(high.tolist(), low.tolist(), strict=True))
    assert (high[back] == a).all() and (low[back] == b).all()
    wide = lm.distinct(a << 20, b.astype(np.int64) << 30)
    assert (wide[0] >> 20 == high).all() and (wide[1] >> 30 == low).all() and (wide[2] == back).all()
    x = {"a": a, "b": b.astype(np.uint8), "c": np.zeros(0, np.uint32)}
    assert all((v == x[k]).all() and v.dtype == x[k].dtype for k, v in lm.expand(lm.squeeze(x)).items())


def shard_of(sizes: list[int], block: int, monkeypatch) -> tuple:
    """A shard that takes all n-grams of some chunks: its arrays, answers, n-grams asked for and the peak of memory."""
    monkeypatch.setattr(lm, "_BLOCK", block)
    r = np.random.default_rng(5)
    chunks = [np.minimum(r.zipf(1.3, n), 5000).astype(np.int64) - 1 for n in sizes]
    counts = sum(np.bincount(c, minlength=5000) for c in chunks)
    known = lm.Known(1, np.zeros((64, 1), np.int64), 5000, int(counts.sum()), 1, 3)
    asks = []
    for codes in chunks:
        x = {"codes": codes, "size": np.full(len(codes) // 100, 100), "train": np.ones(len(codes) // 100, np.uint8)}
        ids = np.where(counts > 0, np.arange(5000), -1)
        asks += [lm.expand(blob) for _, blob in lm.Grams(x, ids, counts, known).asks(ids, counts)]
    n = sum(len(x["w0"]) + len(x["w1"]) for x in asks)
    tracemalloc.start()
    try:
        asked = lm.Asked(asks, 3)
        parts, nodes, sums, mass = asked.grow(1, lm.DISCOUNT)
        answers = list(asked.answers(lm.mapped(parts)))
        return parts, nodes, sums, mass, answers, n, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_slices_of_a_shard_change_nothing(monkeypatch):
    whole, cut = (shard_of([3000, 100, 2000], block, monkeypatch) for block in (1 << 30, 97))
    assert whole[1:3] == cut[1:3] and (whole[3] == cut[3]).all() and whole[0].keys() == cut[0].keys()
    assert all((v == cut[0][k]).all() for k, v in whole[0].items())
    assert all((v == y[k]).all() for x, y in zip(whole[4], cut[4], strict=True) for k, v in x.items())


def test_memory_of_a_shard(monkeypatch):
    *_, n, peak = shard_of([150_000] * 4, 1 << 14, monkeypatch)
    assert n > 400_000 and peak < 60 * n


def test_scores_equal_a_plain_model(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, "documents").collect()]
    got = {r["doc_id"]: r for r in queries.op2_lm_score(spark, SF).collect()}
    words = {d: t.encode().lower().split() + [b""] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d, _ in docs}
    counts = [defaultdict(int) for _ in range(4)]
    for d, w in words.items():
        if not held[d]:
            for n in (1, 2, 3):
                for i in range(len(w) - n + 1):
                    counts[n][tuple(w[i : i + n])] += 1
    total, kinds = sum(counts[1].values()), len(counts[1])
    kept = counts
    mass = [None, None, defaultdict(float), defaultdict(float)]
    for n in (2, 3):
        for g, c in kept[n].items():
            mass[n][g[:-1]] += (c - lm.DISCOUNT) / kept[n - 1][g[:-1]]
    for d, w in words.items():
        base = score = 0.0
        for i in range(len(w)):
            p = (counts[1].get((w[i],), 0) + 0.5) / (total + 0.5 * (kinds + 1))
            base += np.log10(p)
            for n in (2, 3):
                g = tuple(w[i - n + 1 : i + 1])
                if i < n - 1 or g[:-1] not in kept[n - 1]:
                    break
                p = (max(kept[n].get(g, 0) - lm.DISCOUNT, 0)) / kept[n - 1][g[:-1]] + max(1 - mass[n][g[:-1]], 1e-12) * p
            score += np.log10(p)
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], len(w), sum((x,) in counts[1] for x in w), total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=5e-3, abs=0.02)
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_model_keeps_what_was_seen_once(spark):
    rows = [(i, t) for i, t in enumerate(("a b c d", "a b e", "f b c g", "b c", "h", "b c d a"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    counts = [defaultdict(int) for _ in range(4)]
    words = {d: [*t.split(), ""] for d, t in rows}
    for w in words.values():
        for n in (1, 2, 3):
            for i in range(len(w) - n + 1):
                counts[n][tuple(w[i : i + n])] += 1
    model = lm.train(df.select("text"))
    assert model.nodes == [len(c) for c in counts[1:]] and model.totals == [sum(c.values()) for c in counts[1:]]
    for r in lm.score(df, model).collect():
        w, score = words[r["doc_id"]], 0.0
        for i in range(len(w)):
            p = (counts[1][w[i],] + 0.5) / (model.totals[0] + 0.5 * (model.nodes[0] + 1))
            for n in (2, 3)[:i]:
                g = tuple(w[i - n + 1 : i + 1])
                after = [c for x, c in counts[n].items() if x[:-1] == g[:-1]]
                p = (counts[n][g] - lm.DISCOUNT + max(counts[n - 1][g[:-1]] - sum(after) + lm.DISCOUNT * len(after), 1e-12) * p) / counts[n - 1][g[:-1]]
            score += np.log10(p)
        assert r["score"] == pytest.approx(score, rel=1e-3)
    assert lm.train(df.select("text"), min_count=2).nodes == [len(counts[1]), *[sum(c > 1 for c in x.values()) for x in counts[2:]]]


def test_language_model_on_odd_and_no_texts(spark, odd, odd_frame, none):
    model = lm.train(odd_frame.select("text"))
    got = lm.score(odd_frame, model).collect()
    assert len(got) == len(odd) and all(r["n_known"] == r["n_tokens"] for r in got)
    both = lm.train_and_score(odd_frame, F.lit(True)).collect()
    assert sorted(map(tuple, both), key=repr) == sorted(map(tuple, got), key=repr)
    assert lm.score(none, model).count() == 0 and lm.train_and_score(none, F.lit(True)).count() == 0
    empty = lm.score(odd_frame, lm.train(none.select("text"))).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in empty)


# --- html ---


def test_html_blocks_and_characters():
    page = "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><p>a &amp;\n b<br>c<p><b>d</b><td>e</td><!-- x --><div>f"
    assert [b.text for b in html.leaf_blocks(page)] == ["a & b c", "d", "e", "f"]
    assert html.leaf_blocks("") == [] and html.main_text("", html.default_field()) == ""


@pytest.mark.parametrize("name", ["svg", "math", "object", "noscript", "template"])
def test_html_elements_without_an_end(name):
    assert [b.text for b in html.leaf_blocks(f"<p>a</p><{name}><p>b</p><{name} x=1><p>c")] == ["a", "b", "c"]


def test_html_formulas_and_fallback_text():
    page = "<article><p>so <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> holds</p><p>see <object data=f><param name=q>the figure</object> here</p><p>no <svg><text>label</text></svg>drawing</p></article>"
    blocks = html.leaf_blocks(page)
    assert [b.text for b in blocks] == ["so x=1 holds", "see the figure here", "no drawing"]
    assert all(b.tags == ("article", "p") for b in blocks)


def test_html_held_out_accuracy():
    field = html.train(html.training_pages(300, seed=1))
    pairs = [(x, y) for blocks, labels in html.training_pages(120, seed=2) for x, y in zip(field.decode(blocks), labels, strict=True)]
    assert sum(x == y for x, y in pairs) / len(pairs) > 0.97


def test_html_pages(spark):
    rows = {r["page_id"]: r["html"] for r in table(spark, "pages").collect()}
    for r in queries.op3_html_extract(spark, SF).collect():
        page = rows[r["page_id"]]
        inner = page[page.index("<article>") + 9 : page.index("</article>")]
        assert r["text"] == "\n\n".join(b.text for b in html.leaf_blocks(inner)) and r["n_chars"] == len(r["text"])


def test_html_tables_depth_and_length(spark):
    cells = "<html><body><table><tr><td class='menu'><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></td><td>{}</td></tr></table></body></html>"
    prose = [f"Paragraph {i} of the article goes on for a while, with enough words to be one." for i in range(4)]
    deep = "<div>" * 3000 + "".join(f"<p>{x}</p>" for x in prose) + "</div>" * 3000
    long = "<article>" + "".join(f"<p>{x}</p>" for x in prose * 5000) + "</article>"
    rows = [(0, cells.format("".join(f"<p>{x}</p>" for x in prose))), (1, f"<article>{deep}</article>"), (2, long)]
    df = spark.createDataFrame([(i, "u", h, "x", "x") for i, h in rows], "page_id long, url string, html string, text string, n_chars string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got == {0: "\n\n".join(prose), 1: "\n\n".join(prose), 2: "\n\n".join(prose * 5000)}
    assert html.extract(df.where("false")).count() == 0


def test_html_nulls_and_clutter(spark):
    clutter = "<nav><a href=x>home</a></nav><div class='cookie notice'>We use cookies.</div><article><h1>Title words</h1><p>First paragraph of the text, long enough.</p><p>Second one.</p></article><section id=comments><div class=comment><p>Nice post!</p></div></section><form><label>Name</label><input></form><footer>© us</footer>"
    df = spark.createDataFrame([(1, None, None), (2, "u", clutter), (2, "u", clutter)], "page_id long, url string, html string")
    assert [r["text"] for r in html.extract(df).orderBy("page_id").collect()] == ["", *["Title words\n\nFirst paragraph of the text, long enough.\n\nSecond one."] * 2]


# --- toxicity ---


def test_toxicity_chain(spark, odd_frame, odd, none):
    r = random.Random(5)
    plain = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        own = [r.choice(plain) for _ in range(30)]
        bad = i % 6 == 0
        if bad:
            own[r.randrange(30)] = r.choice(("idiot", "scum", "pathetic"))
        rows.append((i, " ".join(own), int(bad)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2 == 0] + [(None, 1), (5, None)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x["rejected"] for x in toxicity.score(docs, chain).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows) >= 597
    assert toxicity.keep_clean(docs, chain).count() == sum(not x for x in got.values())
    assert toxicity.score(odd_frame, chain).count() == len(odd) and toxicity.score(none, chain).count() == 0
    blank = toxicity.fit(docs, labels.where("false"))
    assert toxicity.score(docs, blank).where("rejected").count() == 0
    twice = toxicity.fit(docs.unionByName(docs).unionByName(docs.select("doc_id", F.lit("zzz").alias("text"))), labels.unionByName(labels))
    assert all((a.names == b.names).all() and np.allclose(a.weights, b.weights) for a, b in zip(twice.models, chain.models, strict=True))


def test_toxicity_on_labels_held_out(spark):
    """Recall and precision on labelled documents that were not trained on."""
    at = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    trains = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2)) == 0
    chain = toxicity.fit(docs, labels.where(trains))
    seen = docs.join(labels.where(trains), "doc_id", "left_semi").select("text").distinct()
    own = docs.join(seen, "text", "left_anti").join(labels.where(~trains), "doc_id")  # nor copies of what was
    got = toxicity.score(own, chain).join(labels, "doc_id").groupBy("toxic", "rejected").count().collect()
    n = {(r["toxic"], r["rejected"]): r["count"] for r in got}
    caught, missed, wrong = n.get((1, True), 0), n.get((1, False), 0), n.get((0, True), 0)
    print("held out", caught, missed, wrong)
    assert caught + missed > 100 and caught >= 0.9 * (caught + missed) and caught >= 0.9 * (caught + wrong)


# --- packing ---


def check_pieces(pieces, docs, capacity=2048):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = defaultdict(list)
    for d, t in docs:
        ids[d].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    covered, windows = defaultdict(int), defaultdict(list)
    for p in pieces:
        own = ids[p["doc_id"]][0]
        assert p["doc_tokens"] == len(own) and p["ids_crc32"] == zlib.crc32(own[p["start"] : p["start"] + p["length"]].tobytes())
        covered[p["doc_id"]] += p["length"]
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    assert covered == {d: sum(len(x) for x in own) for d, own in ids.items()}
    for own in windows.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0


def test_packing(spark, odd, odd_frame, none):
    check_pieces(packing.pack(odd_frame).collect(), odd)
    check_pieces(queries.op5_packing(spark, SF).collect(), texts(spark))
    assert packing.pack(none).count() == 0


def test_packing_of_added_tokens(spark):
    quoted = ["hello <|endoftext|> world", "<|endoftext|>", "a  <|endoftext|><|endoftext|>  b\n", "<|endoftext|", "<|<|endoftext|>|>", "it's  <|endoftext|>'s"]
    rows = list(enumerate(quoted))
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_pieces(pieces, rows)
    assert next(p["doc_tokens"] for p in pieces if p["doc_id"] == 0) == 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60))
def test_packer_invariants_and_choice(sizes):
    machine = packing.SumOfSquares(32)
    pieces = []
    for i, n in enumerate(sizes):
        rest = n % 32
        if rest:  # the level chosen is the best of all by direct trial
            def cost(f, rest=rest):
                c = machine.counts.copy()
                if f:
                    c[f] -= 1
                if f + rest < 32:
                    c[f + rest] += 1
                return int((c[:32] ** 2).sum())

            choice = machine.level(rest)
            assert cost(choice) == min(cost(f) for f in range(0, 33 - rest) if f == 0 or machine.counts[f])
        pieces += machine.add(i, n)
    pieces += machine.close()
    assert sum(p[2] for p in pieces) == sum(sizes)
    fill = defaultdict(int)
    for p in pieces:
        fill[p[3]] += p[2]
    assert all(x == 32 or x & (x - 1) == 0 for x in fill.values()) and sum(x < 32 for x in fill.values()) <= 5


# --- decontamination ---


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=50).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=12), st.binary(max_size=400).map(lambda b: bytes(x % 3 + 97 for x in b)))
def test_wu_manber(patterns, hay):
    patterns = sorted(set(patterns))
    at, which = decontaminate.WuManber(patterns).search(hay)
    want = sorted((i, k) for k, p in enumerate(patterns) for i in range(len(hay)) if hay.startswith(p, i))
    assert sorted(zip(at.tolist(), which.tolist(), strict=True)) == want


def digest(out):
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").alias("n"), F.sha2(names.cast("binary"), 256), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")))


@pytest.mark.parametrize("block", [decontaminate.BLOCK_ITEMS, 4])
def test_decontamination(spark, odd, odd_frame, none, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", block)
    items = [(i, t) for i, t in odd[9:25]] + [(100, None), (101, ""), (102, "one"), (103, odd[-6][1]), (104, odd[60][1])]
    bench = spark.createDataFrame([*items, (None, "one")], "item_id long, text string")
    same(digest(decontaminate.find_contamination(odd_frame, bench)), brute.decontaminate(odd, items))
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(odd_frame, bench.where("false")).where("n_hit > 0").count() == 0


def test_decontamination_query(spark):
    items = [(r["item_id"], r["text"]) for r in table(spark, "benchmark").collect()]
    same(queries.op6_decontaminate(spark, SF).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"), brute.decontaminate(texts(spark), items))


# --- shared passages ---


@pytest.mark.parametrize("flush", [passages._FLUSH, 40])
def test_shared_passages(spark, odd, odd_frame, none, monkeypatch, flush):
    monkeypatch.setattr(passages, "_FLUSH", flush)

    def found(rows, n):
        own = [(i, brute.lower(t or "").encode().split()) for i, t in rows]
        at = defaultdict(set)
        for i, w in own:
            for j in range(len(w) - n + 1):
                at[tuple(w[j : j + n])].add(i)
        return set().union(*[d for d in at.values() if len(d) > 1])

    for rows, frame in ((odd, odd_frame), (texts(spark), table(spark, "documents"))):
        got = {r["doc"] for r in passages.shared_passages(frame).collect()}
        assert found(rows, passages.WORDS) <= got <= found(rows, passages.WORDS - passages.SLACK)
        assert {r["doc"] for r in passages.shared_passages(frame, words=12, slack=0).collect()} == found(rows, 12)
    assert passages.shared_passages(none).count() == 0


# --- Jaccard join ---


def test_jaccard(spark, odd, odd_frame, none):
    same(jaccard.join(odd_frame).select("doc_id", "n_shingles", "component_id"), brute.jaccard(odd))
    assert jaccard.join(none).count() == 0


def test_jaccard_query(spark):
    same(queries.op7_jaccard_join(spark, SF), brute.jaccard(texts(spark)))


@pytest.mark.parametrize("rows", [jaccard.UNIT_ROWS, 3])
def test_jaccard_units_and_frequent_bound(odd, odd_frame, monkeypatch, rows):
    monkeypatch.setattr(jaccard, "UNIT_ROWS", rows)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    monkeypatch.setattr(jaccard, "_PASS", 1000)
    monkeypatch.setattr(jaccard, "_PAIRS", 50)
    monkeypatch.setattr(jaccard, "MAX_FREQUENT", 40)
    same(jaccard.join(odd_frame).select("doc_id", "n_shingles", "component_id"), brute.jaccard(odd))


def test_bitmaps_only_rule_out():
    r = np.random.default_rng(2)
    for n in (1, 3, 64, 65, 700, 3000):
        x = r.integers(0, 1 << 63, n).astype(np.uint64)
        y = np.unique(np.concatenate([x[: int(n * 0.9)], r.integers(0, 1 << 63, n // 5).astype(np.uint64)]))
        x = np.unique(x)
        batch = pa.RecordBatch.from_pydict({"k": [b"x", b"y"], "tokens": [x.tobytes(), y.tobytes()]})
        a, b = (np.frombuffer(v, np.uint8)[None] for v in next(iter(jaccard._bitmaps(2)([batch]))).column("bits").to_pylist())
        size = min(a.shape[1], b.shape[1])
        differ = np.bitwise_count(jaccard._folded(a, size) ^ jaccard._folded(b, size)).sum()
        assert differ <= len(np.setxor1d(x, y))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 10_000), st.integers(2, 60), st.integers(0, 6), st.sampled_from([0.0, 0.3, 1.0]))
def test_similar_sets_share_a_key(seed, n, changes, share):
    r = np.random.default_rng(seed)
    x = r.integers(0, 1 << 63, n).astype(np.uint64)
    y = x.copy()
    y[r.integers(0, n, changes)] = r.integers(0, 1 << 63, changes).astype(np.uint64)
    x, y = np.unique(x), np.unique(y)
    common = len(np.intersect1d(x, y))
    often = np.unique((r.choice(np.union1d(x, y), int(share * n)) >> np.uint64(32)).astype(np.uint32)) if share else np.zeros(0, np.uint32)
    if 100 * common >= 80 * (len(x) + len(y) - common) and not np.array_equal(x, y):
        (a, ra), (b, rb) = jaccard.index_keys(x, often), jaccard.index_keys(y, often)
        keys, i, j = np.intersect1d(a, b, return_indices=True)
        assert len(keys) and (180 * np.minimum(ra[i], rb[j]) >= 80 * (len(x) + len(y))).any()


def unit_of(clusters: list[int], weight: int = 1) -> pa.RecordBatch:
    """A unit, given twice as two groups, whose members are components of their own and alike within a cluster."""
    n = sum(clusters)
    which = np.repeat(np.arange(len(clusters)), clusters)
    bits = [np.where(np.arange(64) == c, 255, 0).astype(np.uint8).tobytes() for c in which.tolist()]
    keys = [int(x).to_bytes(16, "big") for x in range(n)]
    one = {"qb": pa.array(np.zeros(2 * n, np.int32)), "tb": pa.array(np.zeros(2 * n, np.int32)), "k": pa.array(keys * 2, pa.binary()), "n": pa.array(np.full(2 * n, 20)), "m": pa.array(np.full(2 * n, 20))}
    one |= {"label": pa.array(np.tile(np.arange(n) * 7 - 40, 2)), "weight": pa.array(np.full(2 * n, weight)), "query": pa.array([True] * 2 * n), "target": pa.array([True] * 2 * n), "bits": pa.array(bits * 2, pa.binary())}
    return pa.RecordBatch.from_pydict({"gid": pa.array(np.repeat([1, 2], n))} | one)


def test_members_with_allowed_partners_grow_with_members():
    for clusters in ([40], [300], [5, 1, 9, 1, 200]):
        batch = unit_of(clusters)
        got = [r for b in jaccard._plausible(80)(iter([batch])) for r in b.to_pylist()]
        which = np.repeat(np.arange(len(clusters)), clusters)
        found = defaultdict(set)
        for r in got:
            found[r["gid"]].add(int.from_bytes(r["k"], "big"))
        assert sorted(map(sorted, found.values())) == sorted(np.flatnonzero(which == c).tolist() for c, size in enumerate(clusters) if size > 1)
        assert len(got) <= batch.num_rows  # not a row or two for each allowed pair
    assert not [r for b in jaccard._plausible(80)(iter([unit_of([1, 1, 1])])) for r in b.to_pylist()]


# --- chats ---


def test_chats(spark, none):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\<|im_end|>\\\\<\\|x"), (1, 1, "assistant", "a"), (1, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (None, 3, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text"))))
    _, loss, text = chat.read_back(F.col("formatted"), F.col("loss_mask"))
    got = out.select("conv_id", "n_turns", F.sha2(text.cast("binary"), 256), F.length(loss), F.sha2(loss.cast("binary"), 256))
    plain = [(c, -1 if t is None else t, r, x) for c, t, r, x in rows]
    same(got, brute.chats(plain))


def test_chat_query(spark):
    rows = [tuple(r) for r in table(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    odd = "<|im_end|><|im_start|>assistant ok"
    out = queries.op8_chat_format(spark, SF)
    same(out.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256"), brute.chats([*rows, (-1, 0, "user", odd), (-1, 1, "assistant", odd)]))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_chat_parts(spark):
    part = chat.PART_TYPE
    rows = [(1, 0, "user", [("text", "see <|image:x|>", None, None, None, None, None), ("image", None, "a.png", 56, 28, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c|>.pdf", None, None, None, 3), ("odd", "kept", None, None, None, None, None)])]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")).first()
    assert r["formatted"] == "<|im_start|>user<|im_sep|>see <\\|image:x|><|image:a.png|><|audio:b.wav|><|document:c%7C%3E.pdf|>kept<|im_end|>"
    assert [(a["place"], a["type"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(1, "image", "a.png", 3), (2, "audio", "b.wav", 50), (3, "document", "c|>.pdf", 1536)]
    assert r["expanded_tokens"] == 1589 and r["loss_mask"] == [False]


def test_chat_texts_in_parts_equal_one_text(spark):
    r = random.Random(5)
    pieces = ["<", "|", "<|", "im_end|>", "im_start|>", "|>", "\\", "assistant", "a", "", None]
    rows, want = [], []
    for i in range(300):
        turns = [[r.choice(pieces) for _ in range(r.randint(0, 7))] for _ in range(2)]
        rows += [(i, t, role, [("text", x, None, None, None, None, None) for x in own]) for t, (role, own) in enumerate(zip(("user", "assistant"), turns, strict=True))]
        want += [(i, t, role, "".join(x or "" for x in own)) for t, (role, own) in enumerate(zip(("user", "assistant"), turns, strict=True))]
    rows.append((300, 0, "user", [("text", "a<", None, None, None, None, None), ("text", "|im_end|><|im_start|>assistant<|im_sep|>x", None, None, None, None, None)]))
    want.append((300, 0, "user", "a<|im_end|><|im_start|>assistant<|im_sep|>x"))
    out = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>"))
    _, loss, text = chat.read_back(F.col("formatted"), F.col("loss_mask"))
    same(out.select("conv_id", "n_turns", F.sha2(text.cast("binary"), 256), F.length(loss), F.sha2(loss.cast("binary"), 256)), brute.chats(want))


def test_chat_without_rows(spark):
    assert chat.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts array<{chat.PART_TYPE}>, formatted string, n_turns int")).count() == 0


# --- lines ---


def test_lines(spark, odd, odd_frame, none):
    cols = ["doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)]
    same(linededup.dedup_lines(odd_frame).select(*cols), brute.linededup(odd))
    assert linededup.dedup_lines(none).count() == 0


def test_carried_columns_of_any_name(spark):
    names = ["doc", "mark", "text_", "keep", "row", "kept_text", "n_lines", "n_dropped", "_text", "c0", "a b"]
    df = spark.createDataFrame([(i, "a line of text", *[f"{i}{n}" for n in names]) for i in range(3)], ["doc_id", "text", *names])
    out = linededup.dedup_lines(df, carry=tuple(f"`{n}`" for n in names))
    assert out.columns == ["doc_id", *names, "kept_text", "n_lines", "n_dropped"]
    assert sorted(tuple(r) for r in out.collect()) == [(i, *[f"{i}{n}" for n in names], "a line of text" if i == 0 else "", 1, int(i > 0)) for i in range(3)]


def test_ids_are_integers(spark):
    df = spark.createDataFrame([("x", "text")], "doc_id string, text string")
    for f in (jaccard.join, linededup.dedup_lines, substring.remove_repeats, passages.shared_passages):
        with pytest.raises(TypeError, match="doc_id must be an integer column"):
            f(df)
    with pytest.raises(TypeError, match="item_id"):
        decontaminate.find_contamination(df, df.withColumnRenamed("doc_id", "item_id"))


def test_lines_by_shuffle(odd, odd_frame, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    same(linededup.dedup_lines(odd_frame).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256)), brute.linededup(odd))


def test_lines_of_one_hot_line(spark):
    rows = [(i, f"the common line\nown {i} line of text\nthe common line") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    same(linededup.dedup_lines(df).select("doc_id", "n_lines", "n_dropped"), [(i, 3, 0 if i == 0 else 2) for i in range(300)])
    maps = linededup.keep_bitmaps(df).collect()
    assert len(maps) == 299 and all(np.unpackbits(np.frombuffer(zlib.decompress(m["keep"]), np.uint8), bitorder="little")[:3].tolist() == [0, 1, 0] for m in maps)


def test_line_query(spark):
    same(queries.op9_line_dedup(spark, SF), brute.linededup(texts(spark)))


# --- substrings ---


def test_substrings(spark, odd, odd_frame, none):
    cols = ["doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)]
    same(substring.remove_repeats(odd_frame).select(*cols), brute.substrings(odd))
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_substrings_of_small_lengths(spark, seed):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("ab") for _ in range(r.choice((0, 5, 23, 24, 25, 90, 300))))) for i in range(25)]
    rows += [(100 + i, rows[r.randrange(25)][1][r.randrange(9) :] + "c" * r.randrange(70)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cols = ["doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)]
    same(substring.remove_repeats(df, length=24, unit=4).select(*cols), brute.substrings(rows, 24))


def test_substrings_in_pieces_and_by_shuffle(odd, odd_frame, monkeypatch):
    monkeypatch.setattr(substring, "BLOCK", 700)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    cols = ["doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)]
    same(substring.remove_repeats(odd_frame).select(*cols), brute.substrings(odd))


def test_doubling_over_every_position(odd, odd_frame, none):
    starts = substring.repeated_positions(odd_frame.where("doc_id < 60"), length=48, rounds=4).select("doc", "pos").collect()
    rows = [(i, (t or "").encode()) for i, t in odd if i < 60]
    at = defaultdict(list)
    for i, t in rows:
        for j in range(len(t) - 47):
            at[t[j : j + 48]].append((i, j))
    assert sorted({tuple(r) for r in starts}) == sorted({x for own in at.values() if len(own) > 1 for x in own})
    assert substring.repeated_positions(none).count() == 0


def test_substring_query(spark):
    same(queries.op10_substring_dedup(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), brute.substrings(texts(spark)))
