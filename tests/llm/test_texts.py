import hashlib
import math
import random
import time
from collections import Counter
from fractions import Fraction

import numpy as np

from credalis.llm import chat, html_text, mixing

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "[", "<", "/", "é", "日本", "🙂", " ", "\n", "a", "[\\INST]", "[ROLE]", "[TEXT]", "[SYS", "SYS]", "\\\\", "<\\s>", "\u0301", "'s"]


def test_chat_round_trips_and_masks():
    rng = random.Random(1)
    t = chat.tokenizer(chat.TOKENIZER)
    for _ in range(1500):
        turns = [(rng.choice(["user", "assistant", "system", "x" + rng.choice(BITS), ""]), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        c = chat.render(turns)
        assert chat.read_back(c.text) == turns
        offsets = np.array(t.encode(c.text, add_special_tokens=False).offsets).reshape(-1, 2)
        mask = chat.loss_mask(c, offsets)
        assert chat.masked_texts(c, offsets, mask) == "".join(x for r, x in turns if r == "assistant")


def test_chat_table(spark):
    rows = [(1, 1, "assistant", "yes [/INST]", 0), (1, 0, "user", None, 0), (2, 0, None, "hm", 0), (2, 0, None, "hm", 0), (None, 3, "assistant", "x" * 5000, 0), (3, None, "odd [TEXT]", "\\", 0)]
    got = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, formatted int")).collect()}
    assert got[1].roles == ["user", "assistant"] and got[1].texts == ["", "yes [/INST]"] and got[1].loss_text == "yes [/INST]"
    assert got[2].roles == ["", ""] and got[2].texts == ["hm", "hm"] and got[2].loss_text == ""
    assert got[None].loss_text == "x" * 5000 and got[3].roles == ["odd [TEXT]"] and got[3].texts == ["\\"]
    assert len(got[1].token_ids) == len(got[1].loss_mask)
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
    assert chat.sha256("a") == hashlib.sha256(b"a").hexdigest()


ARTICLE = '<h1>Head &amp; tail</h1><p><b>First &eacute; paragraph with words enough to be text.<br>next&nbsp;line<p>Short.</p><section><p>Deeper text that belongs to it as well, of some length.</p><blockquote>Quoted words of somebody.</blockquote></section><ul><li>One<li>Two</ul>'
WANT = "Head & tail\n\nFirst é paragraph with words enough to be text. next line\n\nShort.\n\nDeeper text that belongs to it as well, of some length.\n\nQuoted words of somebody.\n\nOne\n\nTwo"
AROUND = [
    '<html><head><title>T</title><style>p{}</style><script>if(a<b)"</p>";</script></head><body><nav><ul><li><a href="/a">Home</a><li><a href=/b>News</a></ul></nav><div class="ad">Buy now, a long advert text that goes on and on and on for many words indeed.</div>{}<footer>&copy; me</footer></body></html>',
    '<body><div id="header"><a href=x>logo</a></div><div class="cookie-notice">We use cookies, and we have much to say about them here.</div><div id="wrap">{}</div><div class="sidebar"><p>Links and more</p><a href=a>b</a></div><div id="comments"><p>Great post, I agree with everything that was said in it, really.</p></div></body>',
    '<BODY><header><p>Site name and a claim</p></header><form action="x"><label>Search</label><input name=q></form>{}<aside>More of this</aside><noscript>Turn it on</noscript>',
]


def test_html_keeps_the_article_only():
    for page in AROUND:
        for box in ("<article>{}</article>", "<main>{}</main>", '<div class="content">{}</div>', '<div class="main with-sidebar"><article>{}</article></div>'):
            assert html_text.main_text(page.replace("{}", box.replace("{}", ARTICLE))) == WANT, (page, box)


def brute_densities(node):
    """By the definition, each count made anew from the whole subtree: {node: (density, sum of its children's)}."""
    below = lambda x: [y for c in x.children if not c.cut for y in (c, *below(c))]
    chars = lambda x: sum(len("".join(t.split())) for y in (x, *below(x)) for t in y.parts if isinstance(t, str))
    links = lambda x: chars(x) if x.tag == "a" else sum(links(c) for c in x.children if not c.cut)
    body = next((y for y in (node, *below(node)) if y.tag == "body"), node)
    ratio = links(body) / max(1, chars(body))

    def density(x):
        c, lc = chars(x), links(x)
        t, lt = max(1, len(below(x))), sum(y.tag == "a" for y in (x, *below(x)))
        if c <= t:
            return c / t * 1e-3
        # a logarithm to a base that is a logarithm itself
        return c / t * math.log(max(1 + 1e-9, c / max(1, lc) * t / max(1, lt)), max(1 + 1e-9, math.log(c * lc / max(1, c - lc) + ratio * c + math.e)))

    return {id(x): (density(x), sum(density(c) for c in x.children if not c.cut)) for x in (node, *below(node))}


def test_html_densities_match_the_definition():
    rng = random.Random(4)
    for _ in range(60):
        parts = ["<body>"]
        for _ in range(rng.randint(1, 25)):
            parts.append(rng.choice(["<div>", "</div>", "<p>", "</p>", "<ul><li>", "</ul>", "<a href=x>word</a> ", "<b>bold", "</b>", "some words of text here ", "<br>", "<section>", "</section>"]))
        top = html_text.parse("".join(parts))
        _, order = html_text.measure(top)
        want = brute_densities(top)
        for x in order:
            if x.chars:
                np.testing.assert_allclose((x.density, x.sum), want[id(x)], rtol=1e-9)


PLAIN = [
    '<body><div><ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us</a></ul></div><div><div>{}</div></div><div><a href=/i>Imprint</a> <a href=/p>Privacy</a></div></body>',
    '<body><table><tr><td><a href=/1>One</a><br><a href=/2>Two</a></td><td>{}</td></tr></table><p><a href=x>top</a></p></body>',
    '<body><div class="x1"><div class="x2"><a href=/a>Start</a><a href=/b>Other</a></div><div class="x3">{}</div><div class="x4"><ul><li><a href=/q>More</a></li><li><a href=/r>of it</a></li></ul></div></div></body>',
]


def test_html_article_without_telling_tags_or_names():
    rng = random.Random(8)
    sentence = lambda: " ".join(rng.choice(["some", "words", "of", "an", "article", "that", "nobody", "wrote"]) for _ in range(rng.randint(8, 40)))
    for page in PLAIN:
        for _ in range(40):
            said = [sentence() for _ in range(rng.randint(2, 9))]
            body = "".join(f"<p>{x}</p>" for x in said)
            assert html_text.main_text(page.replace("{}", body)) == "\n\n".join(said), (page, body)


def test_html_hints_are_looked_at():
    prose = "A long paragraph of the article that sits in a part with an odd name, and goes on for quite some words, as prose does, until it ends here at last."
    page = f'<body><div><h1>Head</h1><div class="widget text"><p>{prose}</p></div><p>{prose}</p><div class="share">Share this <a href=x>here</a></div><div class="related"><a href=/1>First other</a> <a href=/2>Second other</a></div></div></body>'
    assert html_text.main_text(page) == f"Head\n\n{prose}\n\n{prose}"


def test_html_reads_hostile_pages_in_linear_time():
    n = 100_000
    began = time.process_time()
    for source in ("<b>" * n + "</i>" * n, "<b><div>" + "<i>" * n + "</b>" * n, "<b>" * n + "<li></li>" * n, "<b>" * n + "<div></div>" * n):
        html_text.parse(source)
    assert time.process_time() - began < 20
    assert len(html_text.main_text("<p>" + "long text " * 300_000)) == 2_999_999


def test_html_odd_pages(spark):
    for source, want in ((None, ""), ("", ""), ("plain  text", "plain text"), ("<div>a < b &amp;& c</div>", "a < b && c"), ("<p>x<!-- y", "x"), ("<script>x", ""), ("<p>&am &#65; &bogus;</p>", "&am A &bogus;"), ("<a b='>'>x</a>", "x"), ("<" * 30, "<" * 30), ("<nav>only menu</nav>", "")):
        assert html_text.main_text(source) == want, source
    html_text.main_text('<a "' * 30_000)
    html_text.main_text("<div>" * 30_000 + "x")
    rows = [(1, "u", "<p>hi</p>", "own"), (1, "u", "<p>hi</p>", "own"), (2, None, None, None)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, tag string")).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "hi", 2), (1, "hi", 2), (2, "", 0)]
    clash = html_text.extract(spark.createDataFrame([(1, "<p>hi</p>", "own", 7)], "page_id long, html string, text string, n_chars int"))
    assert [tuple(r) for r in clash.collect()] == [(1, "hi", 2)] and clash.columns == ["page_id", "text", "n_chars"]
    assert html_text.extract(clash.withColumnRenamed("text", "html").limit(0)).count() == 0


def test_schedule_is_within_one_block_of_the_targets():
    rng = random.Random(2)
    for _ in range(40):
        blocks = {f"s{i}": rng.randint(1, 60) for i in range(rng.randint(1, 12))}
        parts = mixing.phases(blocks, {s: rng.random() for s in blocks}, 100)
        slots = {}
        for p in parts:
            for k in range(p.last - p.first):
                s = p.start + k // len(p.at) * p.period + p.at[k % len(p.at)]
                assert s not in slots
                slots[s] = (p.source, p.first + k)
        assert sorted(slots) == list(range(sum(blocks.values())))
        assert sorted(slots.values()) == sorted((s, k) for s in blocks for k in range(blocks[s]))
        starts = sorted({p.start for p in parts})
        for a, z in zip(starts, starts[1:] + [sum(blocks.values())]):
            share = {p.source: len(p.at) / p.period for p in parts if p.start == a}
            count = Counter()
            for t in range(a, z):
                count[slots[t][0]] += 1
                assert all(abs(count[s] - w * (t + 1 - a)) < 1 for s, w in share.items())


def test_long_schedules_keep_to_the_target_weights():
    blocks = {"big": 6000} | {f"s{i}": 550 + i for i in range(19)}
    for weights in (mixing.smoothed(blocks), {s: n**0.7 for s, n in blocks.items()} | {"s3": 1e-3}):
        parts = mixing.phases(blocks, weights)
        length = min(p.start for p in parts if p.start > 0)
        order = sorted((p.start + k // len(p.at) * p.period + p.at[k % len(p.at)], p.source) for p in parts for k in range(p.last - p.first))
        assert [t for t, _ in order] == list(range(sum(blocks.values())))
        exact = {s: Fraction(weights[s]) / sum(map(Fraction, weights.values())) for s in blocks}
        count = Counter()
        for t, source in order[:length]:
            count[source] += 1
            assert all(abs(count[s] - w * (t + 1)) < 1 for s, w in exact.items()), t


def brute_schedule(blocks, weights):
    """Slot by slot with fractions: of the released blocks the one that is due first; ties by the source's order."""
    left, done, out, start = dict(blocks), dict.fromkeys(blocks, 0), [], 0
    while left:
        w = {s: Fraction(weights.get(s, 0.0)) for s in left}
        active = [s for s in left if w[s] > 0] or list(left)
        total = sum(w[s] or 1 for s in active)
        share = {s: (w[s] or 1) / total for s in active}
        run, t = dict.fromkeys(active, 0), 0
        while all(run[s] < left[s] for s in active):
            ready = [s for s in active if math.floor(run[s] / share[s]) <= t]
            s = min(ready, key=lambda s: (math.ceil((run[s] + 1) / share[s]), active.index(s)))
            out.append((s, done[s] + run[s]))
            run[s], t = run[s] + 1, t + 1
        for s in active:
            done[s], left[s] = done[s] + run[s], left[s] - run[s]
        left = {s: n for s, n in left.items() if n}
    return out


def test_mix_matches_brute_force(spark):
    """The whole table: places of all rows, against a schedule made slot by slot."""
    rng = random.Random(7)
    rows = [(i, rng.choice(["a"] * 9 + ["b"] * 4 + ["c", "d"])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    sizes = Counter(s for _, s in rows)
    for weights in (None, {"a": 1.0, "c": 0.3}):
        got = mixing.mixed(docs, weights, block_docs=8, period=7).collect()
        blocks = {s: -(-sizes[s] // 8) for s in sorted(sizes)}
        want = brute_schedule(blocks, weights or {s: math.sqrt(n) / sum(map(math.sqrt, sizes.values())) for s, n in sizes.items()})
        assert {r.slot: (r.source, r.block) for r in got} == dict(enumerate(want))
        for s in sizes:
            own = sorted((r.block, r.place) for r in got if r.source == s)
            assert own == [(k // 8, k % 8) for k in range(sizes[s])]
        assert {r.doc_id: r.source for r in got} == dict(rows)


def test_mix_of_many_sources(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, rng.choice(["big"] * 60 + [None] * 10 + [f"s{k}" for k in range(40)])) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string")
    monkeypatch.setattr(mixing, "MAX_SOURCES", 8)
    for weights in (None, {"big": 1.0, "s3": 0.5, None: 2.0}):
        got = mixing.mixed(docs, weights, block_docs=4).collect()
        assert sorted((r.doc_id, r.source or "") for r in got) == sorted((i, s or "") for i, s in rows)
        slots = {}
        for r in got:
            assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
        assert sorted(slots) == list(range(len(slots))) and len(set(slots.values())) == len(slots)
        for s in {s for _, s in rows}:  # a source's blocks come in order
            own = [b for _, (x, b) in sorted(slots.items()) if x == s]
            assert own == sorted(own)
        if weights is None:
            size = Counter(s for _, s in rows)
            total, count = sum(map(math.sqrt, size.values())), Counter()
            for t in range(150):
                count[slots[t][0]] += 1
                assert abs(count["big"] - (t + 1) * math.sqrt(size["big"]) / total) < 1


def test_mixed_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["big"] * 8 + ["mid", "mid", "small", None]), "x") for i in range(3000)] + [(5, "big", "x"), (None, "mid", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    got = mixing.mixed(docs, block_docs=4).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "source", "block", "slot", "place"}
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    assert all(len({r.source for r in got if r.slot == s}) == 1 for s in range(0, 700, 97))
    weighted = mixing.mixed(docs, {"small": 1.0, "mid": 1.0}, block_docs=4).collect()
    first = sorted({(r.slot, r.source) for r in weighted})[:20]
    assert Counter(s for _, s in first) == {"small": 10, "mid": 10} and len(weighted) == len(rows)
    assert mixing.mixed(docs.limit(0)).count() == 0
    ordered = mixing.in_order(mixing.mixed(docs)).select("slot", "place").collect()
    assert ordered == sorted(ordered)
