"""Each operator against a brute-force version, on small fixtures with nulls, empty and long texts, ties, repeated rows."""

import collections
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandkv.llm import byte_bpe, exact_dedup, html_text, jaccard, packing, pii, quality, suffix_dedup, token_binary, tokens, toxicity
from strandkv.llm.queries import BYTE_RANKS, ORACLE_SQL, QUERIES, WORD_TOKENIZER

from ..conftest import SF, same_rows

KIND = "doc_id long, text string"
ODD = [(900, None), (901, ""), (902, " \n\t "), (None, "no id"), (None, "no id"), (903, "one"), (904, "Two words"), (905, "two  WORDS"), (906, "x" * 5000), (907, "\U0001F600 é 日本 " * 40), (908, "same text " * 9), (909, "same text " * 9), (909, "same text " * 9)]


def n(x):
    return None if x is None or x != x else int(x)


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    base = [" ".join(rnd.choice(words) for _ in range(rnd.choice((3, 40, 90)))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(30):  # near copies
        w = base[i % 3 + 5].split(" ")
        for _ in range(rnd.choice((1, 2, 5))):
            w[rnd.randrange(len(w))] = "q%d" % rnd.randrange(50)
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, base[7]) for i in range(25)] + ODD
    rnd.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", t) for i, t in texts], KIND + ", _p string, key string").repartition(3).cache()


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], KIND + ", source string")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sql, name):
    same_rows(QUERIES[name](spark, SF).toPandas(), sql.sql(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(docs, texts, keep):
    groups = collections.defaultdict(list)
    for i, t in texts:
        groups[t or ""].append(i)
    pick = max if keep == "largest" else min
    want = collections.Counter()
    for t, ids in groups.items():
        best = pick((i for i in ids if i is not None), default=None)
        want.update((i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids)
    got = exact_dedup.exact_groups(docs, keep=keep, parts=6, samples=8).toPandas()
    assert collections.Counter((n(r.doc_id), n(r.keep_id), r.group_size, r.text_sha256) for r in got.itertuples()) == want
    assert got[got.kept].groupby("text_sha256").size().tolist() == [1] * len(groups)


def test_quality_of_odd_rows(spark, texts):
    df = spark.createDataFrame([(i, t, None if i is None else "h%d" % (i % 2), 1) for i, t in texts], KIND + ", source string, n_chars int")
    got = quality.quality(df, least_docs=2, percent=5).toPandas()
    assert len(got) == len(texts) and not got[got.n_words < 50].kept.any()
    r = got[got.doc_id == 908].iloc[0]
    assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (18, 72, 18, 0)
    clash = df.withColumns({"n_words": F.lit("own"), "kept": F.lit(7), "clean_text": F.lit(1.5), "other": F.lit("stays")})
    same_rows(quality.quality(clash, least_docs=2, percent=5).drop("other").toPandas(), got)
    assert quality.quality(clash).select("other").distinct().count() == 1


def test_common_lines_go_and_depleted_documents_are_rejected(spark):
    own = lambda i: " ".join(f"d{i}w{k}" for k in range(60))
    rows = [(i, f"Common  LINE here\n{own(i)}", "h") for i in range(40)] + [(50, "common line here\n" * 30, "h")] + [(60 + i, own(7), "h") for i in range(30)]
    got = quality.quality(spark.createDataFrame(rows, KIND + ", source string")).toPandas().set_index("doc_id")
    assert got.loc[3].n_removed_lines == 1 and got.loc[3].clean_text == own(3) and got.loc[3].kept
    assert got.loc[50].n_left_words == 0 and not got.loc[50].kept
    assert got.loc[60].kept and got.loc[60].n_removed_lines == 0  # copies of one text count once


def jaccard_brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    members = collections.defaultdict(list)
    for a in range(len(rows)):
        members[root(a)].append(a)
    return collections.Counter((rows[a][0], len(sets[a]), min((rows[b][0] for b in m if rows[b][0] is not None), default=None)) for m in members.values() for a in m)


@pytest.mark.parametrize("k,percent,how", [(3, 90, {}), (5, 80, {}), (3, 80, {"most_shingles": 300, "block_shingles": 150})])
def test_jaccard(docs, texts, k, percent, how):
    got = jaccard.components(docs, k, percent, **how).toPandas()
    assert collections.Counter((n(r.doc_id), n(r.n_shingles), n(r.component_id)) for r in got.itertuples()) == jaccard_brute(texts, k, percent)


def test_machine_is_the_double_loop_over_pairs():
    rng = np.random.default_rng(4)
    m = toxicity.Model(8, rng.random(256) < 0.5, 0.3, rng.normal(0, 1, 256), rng.normal(0, 0.4, (256, 5)))
    for size in (0, 1, 2, 30):
        at = np.sort(rng.choice(256, size, replace=False))
        times = rng.integers(1, 20, size).astype(float)
        x = {int(c): min(np.log2(1 + t), toxicity.MOST_VALUE) for c, t in zip(at, times) if m.kept[c]}
        z = m.bias + sum(m.weights[c] * v for c, v in x.items())
        z += sum((m.factors[a] @ m.factors[b]) * x[a] * x[b] for a in x for b in x if a < b)
        assert abs(m.margin(at, times) - z) < 1e-9


def test_pairs_of_terms_are_learnt():
    """Label: both of two words or neither; apart, neither says anything."""
    rnd, words = random.Random(3), ["w%s" % "".join(random.Random(i).choices("abcdefgh", k=6)) for i in range(80)]
    own, rows = toxicity.Terms(16), []
    for _ in range(900):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        rows.append((*own.of(" ".join(rnd.choices(words, k=25) + ["insult"] * a + ["group"] * b)), int(a == b)))
    m = toxicity.train(rows[:600], 16)
    right = lambda: np.mean([(m.score(at, t) >= 0.5) == y for at, t, y in rows[600:]])
    whole = right()
    m.factors[:] = 0
    assert whole > 0.95 and right() < 0.8


@pytest.mark.parametrize("portion", [1000, 40])
def test_connected(spark, portion):
    rnd = random.Random(8)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(70)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 301 + i) for i in range(40)] + [(-5, -5)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = jaccard.connected(spark.createDataFrame(edges, "a long, b long"), "test", portion=portion)
    assert sorted((r.node, r.root) for r in got.collect()) == sorted((x, root(x)) for x in {x for a, b in edges if a != b for x in (a, b)})


def test_part_hashes_meet_for_every_link():
    rnd = np.random.default_rng(2)
    for percent in (80, 90):
        t = jaccard.Threshold(percent)
        for size in (1, 2, 9, 30, 200, 1500):
            for _ in range(20):
                a = np.unique(rnd.integers(0, 1 << 63, size).astype(np.uint64))
                drop = rnd.integers(0, max(1, size * (100 - percent) // 100) + 1)
                b = np.unique(np.concatenate([a[drop:], rnd.integers(0, 1 << 63, rnd.integers(0, 3)).astype(np.uint64)]))
                both = len(np.intersect1d(a, b))
                if t.linked(both, len(a), len(b)) and (len(a), len(b)) != (both, both):
                    assert len(np.intersect1d(jaccard.part_hashes(a, t), jaccard.part_hashes(b, t)))


def test_other_tokenizer_rules_take_whole_texts(tmp_path, texts):
    import json

    from tokenizers import Tokenizer

    from strandkv.llm.tokens import ChunkEncoder

    with open(WORD_TOKENIZER, encoding="utf-8") as f:
        rules = json.load(f)
    assert not ChunkEncoder(WORD_TOKENIZER).whole
    rules["pre_tokenizer"]["pretokenizers"] = rules["pre_tokenizer"]["pretokenizers"][1:]  # words are no longer parted
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rules, f)
    other, library = ChunkEncoder(path), Tokenizer.from_file(path)
    assert other.whole
    for (_, t), ids in zip(texts, other.encode([t for _, t in texts])):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(6)
    text = np.concatenate([rng.integers(97, 99, 3000), np.tile(rng.integers(97, 123, 40), 20), np.full(300, 97)]).astype(np.uint8)
    raw = text.tobytes()
    for depth in (50, 33, 17, 64):
        at, new = suffix_dedup.deep_shallow(text, np.arange(len(text) - depth + 1), depth)
        got = [raw[i : i + depth] for i in at.tolist()]
        assert got == sorted(got) and sorted(at.tolist()) == list(range(len(text) - depth + 1))
        assert new.tolist() == [k == 0 or got[k] != got[k - 1] for k in range(len(got))]


@pytest.mark.parametrize("hot", [20_000, 3])
def test_suffix_dedup(docs, texts, hot):
    size, first, top = 50, {}, 2**63 - 1
    number = lambda i: top if i is None else i
    for i, t in texts:
        b = (t or "").encode()
        for p in range(len(b) - size + 1):
            w = b[p : p + size]
            first[w] = min(first.get(w, top), number(i))
    want = collections.Counter()
    for i, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if first[b[p : p + size]] < number(i):
                gone[p : p + size] = b"\1" * size
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())] += 1
    got = suffix_dedup.remove_repeats(docs, size, hot=hot).toPandas()
    assert collections.Counter((n(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.itertuples()) == want


def test_deep_shallow_order():
    rnd = np.random.default_rng(1)
    t = rnd.integers(0, 2, 2000).astype(np.uint8)
    t[500:900], t[1500:1700] = t[100:500], 7
    at, new = suffix_dedup.deep_shallow(t, np.arange(1940), 60)
    keys = [t.tobytes()[i : i + 60] for i in at]
    assert keys == sorted(keys) and new.tolist() == [True] + [a != b for a, b in zip(keys, keys[1:])]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_TOKENIZER)


def test_packing(docs, texts, library):
    got = packing.pack(docs, WORD_TOKENIZER, 64, 1, with_ids=True).toPandas()
    want = collections.Counter()
    for i, t in texts:
        x = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.update((i, k, s, tuple(x[s : s + 64])) for k, s in enumerate(range(0, len(x), 64)))
    assert collections.Counter((n(r.doc_id), r.piece, r.start, tuple(r.ids)) for r in got.itertuples()) == want
    assert all(r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got.itertuples())
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 64


def test_plan_is_whole_and_near_the_bound():
    rnd = np.random.default_rng(4)
    for size in (0, 1, 7, 3000):
        counts = np.bincount(np.clip(rnd.lognormal(6.5, 1.2, size).astype(int), 1, 4096), minlength=4097)
        runs, sequences = packing.plan(counts, 4096)
        placed, spans = np.zeros(4097, int), collections.defaultdict(list)
        for length, rank, k, first, each, offset in runs.tolist():
            assert rank == placed[length]
            placed[length] += k
            for i in range(k):
                spans[first + i // each].append((offset + i % each * length, length))
        assert (placed == counts).all() and len(spans) == sequences
        for s in spans.values():
            s.sort()
            assert [o for o, _ in s] == list(np.cumsum([0, *(x for _, x in s)])[:-1]) and sum(x for _, x in s) <= 4096
        least = -(-int(counts @ np.arange(4097)) // 4096)
        assert sequences <= 1.02 * least + 2


def test_token_binary(docs, texts, library):
    got = token_binary.round_trip(docs, WORD_TOKENIZER, 2).toPandas()
    ids = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in texts]
    assert collections.Counter((n(r.doc_id), r.n_tokens, r.ids_crc32) for r in got.itertuples()) == collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    got = got.sort_values("start", ignore_index=True)
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all()
    order = [-1 if n(x) is None else n(x) for x in got.doc_id]
    assert order == sorted(order)


def test_pack_unpack():
    rnd = np.random.default_rng(1)
    rows = [rnd.integers(0, 1 << rnd.integers(1, 32), rnd.integers(0, 30)).astype(np.uint32) for _ in range(60)]
    docs_, counts, ranks = token_binary.read_block(token_binary.block([(k if k % 5 else None, len(x), *token_binary.pack(x)) for k, x in enumerate(rows)]))
    assert docs_ == [k if k % 5 else None for k in range(60)] and counts.tolist() == [len(x) for x in rows] and (ranks == np.concatenate(rows)).all()


@pytest.mark.parametrize("most", [2_000_000, 60])
def test_byte_bpe(docs, texts, most):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTE_RANKS), special_tokens={})
    want = collections.Counter()
    for i, t in texts:
        x = enc.encode_ordinary(t or "")
        want[(i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = byte_bpe.encode_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN, most_words=most).toPandas()
    assert collections.Counter((n(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()) == want


def test_long_words_are_cut_where_no_merge_crosses():
    import public_tokenizers

    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    joint = byte_bpe.Joints(ranks)
    split = byte_bpe.Splitter(public_tokenizers.PATTERN, joint)
    pairs = {x[k : k + 2] for x in ranks for k in range(len(x) - 1)}
    rnd = random.Random(9)
    for _ in range(20):
        word = "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzéüñ日本語") for _ in range(300))
        parts = split.words(word)
        assert b"".join(parts) == word.encode() and len(parts) > 3
        assert not any(a[-1:] + b[:1] in pairs for a, b in zip(parts, parts[1:]))


def test_very_long_words(spark):
    import public_tokenizers
    import tiktoken

    rnd = random.Random(4)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(BYTE_RANKS), special_tokens={})
    texts = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)), "x" * 3000, "ab" * 1000 + " " + "=" * 2000]
    got = byte_bpe.encode_documents(spark.createDataFrame(list(enumerate(texts)), KIND), BYTE_RANKS, public_tokenizers.PATTERN, with_ids=True).collect()
    assert {r.doc_id: (list(r.ids), bytes(r.decoded)) for r in got} == {i: (enc.encode_ordinary(t), t.encode()) for i, t in enumerate(texts)}


def test_decode_ids(spark):
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    df = spark.createDataFrame([([1, 2, 300],), ([],)], "ids array<int>")
    pieces = {v: k for k, v in ranks.items()}
    assert [bytes(r[0]) for r in df.select(byte_bpe.decode_ids(df.ids, ranks)).collect()] == [pieces[1] + pieces[2] + pieces[300], b""]


PAGE = """<html><head><title>no</title><script>var t="</p>";</script></head><body><header><a href=/>Home</a></header><nav><ul><li>menu</li></ul></nav>
<div class="ad">buy</div><!-- gone --><article><h1>A  title</h1><p>First &amp; <b>bo</b>ld<br>line<p>Short.</p><form><input>send</form></article>
<section id="comments"><p>I disagree strongly with all of this text</p></section><aside>side</aside><footer>&copy;</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (3, "w", "<p>cut off <scr"), (4, "x", "<div><a href=a>one</a> <a href=b>two</a></div><div>" + "Plain text of a page without marks. " * 9 + "</div>")]
    got = {n(r.page_id): r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).toPandas().itertuples()}
    assert got[1].text == "A title First & bold line Short." and got[1].n_chars == 32
    assert got[2].text == "" and got[None].text == "" and got[3].text.startswith("cut off")
    assert got[4].text == ("Plain text of a page without marks. " * 9).strip()


def test_html_hidden_elements_end():
    for page, want in [
        ('<article><p>One.<p class="ad">Buy<p>Two.</p><p>Three.</p></article>', "One. Two. Three."),
        ("<article><ul><li>a<li class=share>S<li>b</ul><p>c</article>", "a b c"),
        ("<article><table><tr><td class=side>x<td>y<tr><td>z</table><p>w</article>", "y z w"),
        ("<article><dl><dt>a<dd class=ad>x<dt>b<dd>c</dl></article>", "a b c"),
        ("<article><section><div class=ad>Buy</section><p>b</article>", "b"),
        ("<article><div class=ad><table><tr><td>Buy</div><p>b</article>", "b"),
        ('<article><div class="ad"><div>Buy</div>now</div><p>b</p></div><p>c</p></article>', "b c"),
    ]:
        assert html_text.main_text(page) == want


def test_html_hints_hide_no_wrapper():
    body = "<p>One.</p><p>Two.</p>"
    for page in [
        f'<body class="single no-sidebar">{body}', f'<div class="content with-sidebar">{body}</div>', f'<html class="nav-closed">{body}', f'<body class="sidebar">{body}', f'<div class="sidebar">{body}</div>',
        f'<article class="post no-sidebar">{body}</article>', f'<main class="has-share">{body}</main>', f'<main class="share">{body}</main>', f'<article id="comments">{body}</article>',
        f'<article>{body}<div class="comment-list"><article class="comment-body">I disagree.</article></div></article>', f'<article>{body}</article><article class="comment">I disagree.</article>',
        f'<div>{body}</div><div class="site-footer"><p>Us.</p></div><ul class="share_buttons"><li>Send</ul><div role=navigation>Up</div>',
    ]:
        assert html_text.main_text(page) == "One. Two.", page
    long = "<p>Plain text of a page.</p>" * 20
    assert html_text.main_text(f'<h1>Head</h1><div class="widget">{long}</div>').endswith("Plain text of a page.")


def test_html_unclosed_elements_cut_nothing():
    for page, want in [
        ("<head><title>x</title><body><p>One.</p>", "One."),
        ("<!doctype html><title>a < b</title><meta charset=utf-8><p>One.", "One."),
        ("<head><title>x<body><p>One.", "One."),
        ('<article><p>One <svg viewBox="0 0 1 1"/>two <math/>three.</p><p>Four.</p></article>', "One two three. Four."),
        ("<article><p>One.<svg><path d=x><p>Two.</p></article>", "One. Two."),
        ("<article><p>One.</p><button>Share<p>Two.</p><button><div>Send</div></button><p>Three.</article>", "One. Two. Three."),
        ("<article><p>One.</p><div><select><option>a<option>b</div>Two.<textarea>c<p>Three.</article>", "One. Two. Three."),
        ("<article><p>One.<noscript>Two.<p>Three.<iframe/><p>Four.<textarea><p>no</textarea></article>", "One. Two. Three. Four."),
        ("<article><p>One <noscript><p>no</p></noscript><template><div>no</div></template>two <select><option>no</select>three.</article>", "One two three."),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</article>", "Let x=1 hold."),
        ("<article><p>One.</p><script>cut <p>off</article>", "One."),
    ]:
        assert html_text.main_text(page) == want, page


def test_html_long_line_drops_no_other():
    long = "A very long paragraph. " * 130
    page = f"<h1>A heading of some words</h1><div><p>By one.</p></div><div><p>Before it.</p></div><div><div><p>{long}</p></div></div><div><p>A short end.</p></div><div><div><p>Bye.</p></div></div>"
    assert html_text.main_text(page) == f"A heading of some words By one. Before it. {long}A short end. Bye."
    menu = "<ul>" + "<li><a href=x>Go there</a></li>" * 5 + "</ul>"
    assert html_text.main_text(f"<p>A heading of some words</p>{menu}<p>{long}</p><p>{long}</p><p>{long}</p>{menu}<p>Top</p>{menu}") == f"A heading of some words {long}{long}{long}".strip()


def test_html_distribution_chooses():
    """Window and threshold decide on pages with and without marks: text that stands apart goes or stays with them."""
    menu = "<ul>" + "<li><a href=x>Go there</a></li>" * 4 + "</ul>"
    body = "".join(f"<p>Paragraph {k} of the text, with a number of words in it.</p>" for k in range(5))
    for page in (f"{body}{menu}<p>Ok</p>{menu}{body}", f"<article>{body}<nav>{menu}</nav><p>Ok</p><nav>{menu}</nav>{body}</article>"):
        plain = html_text.main_text(page)
        assert " Ok " not in plain and plain.count("Paragraph") == 10
        assert " Ok " in html_text.main_text(page, share=0.01) and " Ok " in html_text.main_text(page, window=20)
        assert html_text.main_text(page, share=0.01).replace(" Ok ", " ") == plain


def test_html_long_repeated_and_extra(spark):
    long = "<article>" + "<p>Some words &amp; more of them.</p>" * 20_000 + "</article>"
    rows = [(1, "u", long, "x", 1), (1, "u", long, "x", 1), (2, "u", "<p>" + "word " * 200_000, "y", 2)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert [r.text for r in got] == [" ".join(["Some words & more of them."] * 20_000)] * 2 + [("word " * 200_000).strip()]
    assert [(r.page_id, r.n_chars) for r in got] == [(1, 539_999), (1, 539_999), (2, 999_999)]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_base_spans():
    rnd = random.Random(6)
    for _ in range(400):
        t = "".join(rnd.choice("ab.@_1239. -+()") for _ in range(60))
        want = [(*m.span(), "email") for m in EMAIL.finditer(t)] + [(*m.span(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        assert sorted(s for s in pii.base_spans(t) if s[2] in ("email", "ip")) == sorted(want)
    assert [s[2] for s in pii.base_spans("call +1 (743) 555-3824 or 4111 1111 1111 1111")] == ["phone", "card"]


def test_base_cards_and_phones():
    rnd, seen = random.Random(7), collections.Counter()
    body = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    for _ in range(600):
        t = "".join(rnd.choice([" ", "-", "  ", "x", ".", "+", "(", ") ", body(1), body(4), body(4), body(4), body(15), body(16), "4111 1111 1111 1111", "+1 " + body(9)]) for _ in range(7))
        want = []
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            digits = [int(c) for c in m[0] if c.isdigit()]
            total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits)))
            want += [(*m.span(), "card")] if 14 <= len(digits) <= 19 and total % 10 == 0 else []
        want += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        seen.update(k for _, _, k in want)
        assert sorted(s for s in pii.base_spans(t) if s[2] in ("card", "phone")) == sorted(want)
    assert min(seen["card"], seen["phone"]) > 20


def test_best_tags_are_the_best_of_all():
    """Viterbi against every sequence of tags."""
    import itertools

    rng, t = np.random.default_rng(3), pii.Tagger(hidden=3)
    t.p["move"], t.p["first"] = rng.normal(0, 1, t.p["move"].shape), rng.normal(0, 1, pii.TAGS)
    stretches = [(rng.normal(0, 1, (k, pii.TAGS)), bool(k % 2), k > 2) for k in (4, 1, 3, 2, 4, 0)]
    for cells in (1, 7, 1000):
        for (e, starts, ends), got in zip(stretches, t.best(stretches, cells)):
            def score(tags, e=e, starts=starts, ends=ends):
                first = t.p["first"] if starts else t.p["move"][0]
                inside = sum(t.p["move"][a, b] for a, b in zip(tags, tags[1:])) + sum(e[i, k] for i, k in enumerate(tags))
                return first[tags[0]] + inside + (0 if ends else t.p["move"][tags[-1], 0])

            assert not len(e) or tuple(got) == max(itertools.product(range(pii.TAGS), repeat=len(e)), key=score)


def test_overlapping_windows_are_decoded_as_one_text():
    """A tagger that sees one character at a time gives the tags of the whole text, seams or not."""
    t = pii.trained()
    lone = pii.Tagger()
    lone.p = {**t.p, "again": np.zeros_like(t.p["again"])}
    lone.p["table"] = t.p["table"].copy()
    lone.p["table"][:, :, lone.h : 2 * lone.h] = -50  # forgets at once
    text = "ring 1 " + "743 555 3824 " * 30 + "now"
    whole = lone.best([(lone.emissions(pii.coded(text)[None])[0], True, True)])[0]
    want = pii._spans(text, np.arange(len(text)), whole)
    assert pii.added_spans([text], [[]], lone) == [want]


def test_spans_over_the_seams_of_windows():
    """A number is found wherever it lies in a run of digits that many windows cover."""
    for k in range(0, 70, 3):
        text = "on 12 " + "5 or " * k + "call (743) 555-3824 at once, or " + "6 or " * 20
        (found,) = pii.added_spans([text], [[]], pii.trained())
        assert [text[a:b] for a, b, kind in found if kind == "phone"] == ["(743) 555-3824"]


def test_personal_data_digests(spark):
    rows = [(1, "a@b.cc and 10.0.0.1, 4111 1111 1111 1111; +1 (743) 555-3824"), (1, "a@b.cc and 10.0.0.1, 4111 1111 1111 1111; +1 (743) 555-3824"), (2, "no one " * 3000 + "x@y.zz")]
    got = pii.personal_data(spark.createDataFrame([(i, t, 5, "k") for i, t in rows], KIND + ", n_email int, spans string")).collect()
    want = "email:0:6,ip:11:19,card:21:40,phone:42:59"
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, r.spans) for r in got[:2]] == [(1, 1, 1, 1, 1, hashlib.sha256(want.encode()).hexdigest(), want)] * 2
    assert got[2].spans == "email:21000:21006"


def test_tagger_learns_and_adds(spark):
    tagger = pii.trained()
    x, y = pii.labelled(200, 77)
    got = np.stack(tagger.best([(e, True, True) for e in tagger.emissions(x)]))
    assert (got == y).mean() > 0.95 and (got[y > 0] == y[y > 0]).mean() > 0.75
    rows = [(1, "Please write to ann (at) mail.example (dot) com or ring (743) 555-3824 soon"), (2, None), (3, "clean words only, 12 of them in 1999"), (None, "ip 10.2.3.4 here")]
    got = {n(r.doc_id): r for r in pii.personal_data(spark.createDataFrame(rows, KIND), masked=True).toPandas().itertuples()}
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[3].spans == ""
    assert got[None].n_ip == 1 and got[None].masked_text == "ip <IP> here"
    assert "phone" in got[1].spans and got[1].n_phone == 0


def test_tagger_takes_long_addresses_whole():
    spelled = ["christopher.montgomery (at) example (dot) com", "bartholomew_featherstonehaugh-cholmondeley[at]mail.example[dot]com", "ann @ a-rather-long-company-name-of-some-kind.com", "christophermontgomery (at) a-rather-long-company-name-of-some-kind (dot) com"]
    texts = [f"Please write to {x} soon, as we said." for x in spelled]
    _, spans = pii.find(texts, pii.trained())
    assert [pii.mask(t, s) for t, s in zip(texts, spans)] == ["Please write to <EMAIL> soon, as we said."] * len(texts)


def test_tagger_gradients():
    x, y = pii.labelled(2, 5)
    t = pii.Tagger(hidden=3)
    t.p = {k: v.astype(np.float64) for k, v in t.p.items()}
    _, g = t.gradients(x, y)
    for k in t.p:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = t.p[k][i]
        t.p[k][i] = old + 1e-3
        up, _ = t.gradients(x, y)
        t.p[k][i] = old - 1e-3
        down, _ = t.gradients(x, y)
        t.p[k][i] = old
        assert abs((up - down) / 2e-3 - g[k][i]) < 0.01 * abs(g[k][i]) + 0.02


def test_toxicity_learns_pairs(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(600):
        a, b = rnd.random() < 0.5, rnd.random() < 0.5
        words = ["insult"] * a + ["people"] * b + [rnd.choice(("alpha", "beta", "gamma", "delta")) for _ in range(8)]
        rnd.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(9001, None, "x"), (None, "", "x")], KIND + ", score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, None), (7000, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, labels.doc_id < 400).toPandas()
    assert len(got) == 602 and got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    truth = {i: y for i, _, y in rows}
    held = got[(got.doc_id >= 400) & (got.doc_id < 600)]
    assert np.mean([truth[int(r.doc_id)] == r.predicted for r in held.itertuples()]) > 0.95
    none = toxicity.toxicity(docs, labels.where("false")).toPandas()
    assert (none.score < 0.5).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op1_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((got.predicted == got.toxic).mean()) > 0.9


def test_empty_tables(spark, empty):
    import public_tokenizers

    assert exact_dedup.exact_groups(empty).count() == 0
    assert quality.quality(empty).count() == 0
    assert jaccard.components(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert packing.pack(empty, WORD_TOKENIZER).count() == 0
    assert token_binary.round_trip(empty, WORD_TOKENIZER, 2).count() == 0
    assert byte_bpe.encode_documents(empty, BYTE_RANKS, public_tokenizers.PATTERN).count() == 0
    assert pii.personal_data(empty).count() == 0
    assert toxicity.toxicity(empty, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_counts_each_text_once(spark, texts):
    """The counts stand above the joins with the hosts' lines: below, both ways to those count all texts."""
    tree = quality.quality(spark.createDataFrame([(i, "a b c " * 20, f"h{i % 3}") for i in range(90)], "doc_id long, text string, source string"))._jdf.queryExecution().optimizedPlan().toString().split("\n")
    depth = [len(re.match(r"[ :+-]*", x)[0]) for x in tree]
    joins = [(k, d) for k, d in enumerate(depth) if tree[k][d:].startswith("Join")]
    below = [x for k, d in joins for x, e in zip(tree[k + 1 :], itertools.takewhile(lambda e: e > d, depth[k + 1 :]))]
    assert joins and not any("sort_array" in x or "array_sort" in x for x in below) and any("n_repeat_words" in x for x in tree)


def test_encoder_rests_with_a_quarter_of_its_chunks(spark):
    """An idle worker kept up to all of them, while others worked in the same executor."""
    enc = tokens.ChunkEncoder(WORD_TOKENIZER, keep=400)
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(12)]
    before = [x.tolist() for x in enc.encode(texts)]
    assert len(enc.known) > 100
    enc.rest()
    assert len(enc.known) <= 100 and [x.tolist() for x in enc.encode(texts)] == before == [x.ids for x in enc.library.encode_batch(texts, add_special_tokens=False)]


def test_heads_filter_is_read_as_packed_bits(spark):
    ids = [(i * 7919 - 50,) for i in range(2000)] + [(None,)]
    filled = jaccard._heads_filter(spark.createDataFrame(ids, "doc_id long"), 2001)
    own = np.array([x for x, in ids[:-1]], np.int64)
    assert jaccard._in_filter(filled, own).all() and jaccard._in_filter(filled, own * 3 + 1).mean() < 0.1


def test_small_edges_need_one_forest(spark, monkeypatch):
    """With one portion the forest is the answer; it was checked and joined anew by shuffles."""
    names, stage = [], jaccard.stage
    monkeypatch.setattr(jaccard, "stage", lambda df, name, *a, **k: (names.append(name), stage(df, name, *a, **k))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 90), (90, 95)], "a long, b long")
    plan = jaccard.connected(edges, "t")
    assert {(r["node"], r["root"]) for r in plan.collect()} == {(i, 0) for i in range(51)} | {(x, 90) for x in (90, 95, 100)} and len(names) == 2
    many = jaccard.connected(edges, "t", portion=7)
    assert {(r["node"], r["root"]) for r in many.collect()} == {(i, 0) for i in range(51)} | {(x, 90) for x in (90, 95, 100)}


def test_dictionary_is_gathered_a_partition_at_a_time(spark):
    rows = spark.createDataFrame([(b"ab", [1, 2]), (b"c", [3]), (b"def", [4, 5, 70000])], "word binary, ids array<int>").repartition(3)
    dtype = np.dtype("<u4")
    h, n, ids = byte_bpe._gathered(rows.mapInArrow(lambda b: byte_bpe._packed(b, dtype), "h binary, n binary, ids binary"), dtype)
    assert len(h) == 3 and sorted(n.tolist()) == [1, 2, 3] and sorted(ids.tolist()) == [1, 2, 3, 4, 5, 70000]


def test_jaccard_common_phrases_make_no_neighbourhood(spark, monkeypatch):
    """Documents that share a phrase with the next one, but don't link, aren't brought together; links are all found."""
    rng = np.random.default_rng(5)
    words = [[f"w{k}" for k in rng.integers(0, 10**9, 120)] for _ in range(60)]
    for a, b in zip(words, words[1:]):
        b[:12] = a[-12:]
    words += [[*w[:-1], "other"] for w in words[:5]]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")

    def never(*_):
        raise AssertionError("a neighbourhood of documents that don't link")

    monkeypatch.setattr(jaccard, "_across_blocks", never)
    for most in (4096, 0):  # 0: all equal parts connect unseen
        if most == 0:
            monkeypatch.undo()
        got = {r["doc_id"]: r["component_id"] for r in jaccard.components(docs, 3, 80, most_shingles=1000, block_shingles=300, most_alike=most).collect()}
        assert got == {i: i - 60 if i >= 60 else i for i in range(65)}


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for p in (80, 90):
        t = jaccard.Threshold(p)
        for n in (1, 3, 64, 65, 130, 1100, 40_000):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            sets = [a]
            for m in range(1, 6):  # from the same to fewer than link
                k = max(1, int(len(a) * (1 - m * (100 - p) / 400)))
                sets += [a[:k], np.unique(np.append(a[:k], rng.integers(0, 2**64, (n - k) // 2, dtype=np.uint64)))]
            sets.sort(key=len)
            label = jaccard.alike(np.array([len(s) for s in sets]), [jaccard.sketch_of(s) for s in sets], t)
            for i, x in enumerate(sets):
                for j, y in enumerate(sets):
                    both = len(np.intersect1d(x, y))
                    assert not t.linked(both, len(x), len(y)) or label[i] == label[j]
    far = [np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(20)]
    assert len(set(jaccard.alike(np.full(20, 500), [jaccard.sketch_of(s) for s in far], jaccard.Threshold(80)).tolist())) == 20


def test_chunks_of_plain_texts_share_their_pieces():
    """Cases and punctuation make no new chunks; ids are those of whole texts."""
    enc = tokens.ChunkEncoder(WORD_TOKENIZER)
    cores = ["tree", "leaf", "été", "don't", "x2", "a_b"]
    ends = ["", ".", ",", "***", ".'", "!?", "_.", "'s.", "².", "(", "<|", " ."]
    odd = ["<|EndOfText|> Tree.", "<|endoftext|>tree.", "İstanbul. Tree", "é. Tree.", "Tree\n\nLeaf.\tTree.", "日本. Tree.", "'S.'T", "1.5%x"]
    odd += [x["content"] + "Tree." for x in json.loads(enc.library.to_str())["added_tokens"]]
    texts = [" ".join(f(c) + e for c in cores for e in ends) for f in (str, str.upper, str.title)] + odd
    for text, ids in zip(texts, enc.encode(texts)):
        assert ids.tolist() == enc.library.encode(text, add_special_tokens=False).ids, text
    enc = tokens.ChunkEncoder(WORD_TOKENIZER)
    enc.encode([" ".join(f(c) + e for c in ("tree", "leaf") for e in (".", ",", "***", "!?")) for f in (str, str.upper, str.title)])
    assert len(enc.known) <= 6


def test_byte_bpe_plan_holds_the_ranks_once(spark):
    ranks = byte_bpe.read_ranks(BYTE_RANKS)
    words = spark.createDataFrame([(b" tree",)], "word binary")
    plan = byte_bpe.encode_words(words, ranks)._jdf.queryExecution().analyzed().toString()
    assert plan.count("from_json(") == 1


def test_words_of_plain_units_are_those_of_the_pattern():
    import public_tokenizers

    joint = byte_bpe.Joints(byte_bpe.read_ranks(BYTE_RANKS))
    split = byte_bpe.Splitter(public_tokenizers.PATTERN, joint)
    assert split.plain
    cores = ["a", "tree", " tree", "  tree", "\ttree", " ", "été", " ª", "x2", " 2x", "don't", " 's", "日本", "", "ǅ", "_a"]
    for core in cores:
        for tail in ("", ".", "...", "'", ".'", "!s", "_", "²", "…", ".…", "'s."):
            split.plain = True
            got = split.words(core + tail)
            split.plain = False
            assert got == split.words(core + tail), core + tail


class _Counting:
    """The library, and how many strings it was given."""

    def __init__(self, library):
        self.library, self.n = library, 0

    def encode_batch_fast(self, texts, **more):
        self.n += len(texts)
        return self.library.encode_batch_fast(texts, **more)


def test_words_are_encoded_many_in_a_call():
    """One call of the library for each word, and look-ups of each occurrence in Python, took op4 beyond its CPU seconds."""
    enc = tokens.ChunkEncoder(WORD_TOKENIZER)
    enc.bare = _Counting(enc.bare)
    words = ["".join(x) for x in itertools.product("abcdefgh", repeat=4)]
    text = " ".join(words)
    assert enc.encode([text])[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
    assert enc.bare.n < 20 and len(enc.known) == len(words)


def test_chunks_in_bytes_of_odd_texts():
    """Ids are those of whole texts, in a sliced column, over portions of few bytes and with few chunks remembered."""
    rng = random.Random(4)
    bits = [*"aZé×÷ÉªÀɏɐİſK9²_.,'(<|>-\n\t\r日😀", "́", "̸", "’", " ", "\x85", "\xa0", "K", "  ", "\n\n", "tree", "Tree", "don't", "'S", "<|endoftext|>", "<|EndOfText|>", "x" * 60, ". ", " ."]
    texts = [None, "", " ", "\n", *("".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(3000)), None, ""]
    for more in ({}, {"keep": 40, "portion": 50}, {"longest": 3, "portion": 3000}):
        enc = tokens.ChunkEncoder(WORD_TOKENIZER, **more)
        want = [x.ids for x in enc.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [x.tolist() for x in enc.encode(texts)] == want
        assert [x.tolist() for x in enc.encode(pa.array(["other.", *texts], pa.string()).slice(1))] == want
        assert len(enc.known) == len(enc.ids) and all(len(c) <= enc.longest for c in enc.known)
        assert enc.encode([]) == []


def test_byte_bpe_units_in_bytes_of_odd_texts():
    """Units are found in the bytes, each distinct one made once; their words are those of the whole texts."""
    import public_tokenizers
    import regex

    rng = random.Random(5)
    split = byte_bpe.Splitter(public_tokenizers.PATTERN, byte_bpe.Joints(byte_bpe.read_ranks(BYTE_RANKS)), long=10**6)
    bits = [*"aZé×÷ÉªÀɏɐ9²_.,'(<|>-\n\t\r日😀", "\u0301", "\u2019", "\u2028", "\u3000", "\u1680", "\u205f", "\u2003", "\u200b", "\x85", "\xa0", "\x1c", "  ", "\n\n", "tree", "Tree", "don't", "'S", ". ", " ."]
    texts = [None, "", " ", *("".join(rng.choices(bits, k=rng.randrange(1, 30))) for _ in range(5000)), None]
    at = 0
    for raw, offsets in byte_bpe.portions(pa.array(["other.", *texts], pa.string()).slice(1), 3000):
        found, first = split.units(raw, offsets)
        assert len(found.dictionary.unique()) == len(found.dictionary) < len(found)
        units = [found.dictionary[i].as_py() for i in found.indices.to_pylist()]
        for a, b in zip(first.tolist(), first[1:].tolist()):
            assert [w for u in units[a:b] for w in split.words_of(u)] == [w.encode() for w in regex.findall(public_tokenizers.PATTERN, texts[at] or "")], texts[at]
            at += 1
    assert at == len(texts)
