"""Pages, archives, conversations, vectors and piece sampling against brute force and on odd rows."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loanloom.llm import chat, chat_digests, crosspoly, html, mtree, pieces, warc
from loanloom.llm.queries import TOKENIZER

# --------------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu one</a></li></ul></nav><div class="ad">buy now</div><div id="cookie-notice">we use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p>First   para<br>graph &lt;x&gt; &eacute;&#233;.<p>Unclosed <b>bold</b> it<i>al</i>ic
<div class="advert">advert</div><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><aside>side</aside><form>form</form></article>
<section class="comments"><p>nice page</p></section><footer>&copy; host</footer></body></html>"""


def pages(spark, rows):
    schema = "page_id long, url string, html string, text string, row string, about int, zones int"
    return spark.createDataFrame([(*r, "t", "r", 1, 2) for r in rows], schema)


def test_blocks_of_a_page():
    assert html.article_text(html.page_blocks(PAGE)) == "Head & line\nFirst para graph <x> éé.\nUnclosed bold italic\none\ntwo\na\nb"


@pytest.mark.parametrize(("source", "text"), [
    ("", ""), ("<p", ""), ("<article><p>cut off mid se", "cut off mid se"), ("<article>a<p>b</article>c", "a\nb"),
    ("<article><p>x &am", "x &am"), ("<article><p>done</p><foot", "done"), ("<article><!-- c --><p>  x \n y</p></article>", "x y"),
    ("<main><div>1</div>2<div>3</div></main>", "1\n2\n3"), ("<article>a</article><article>b</article>", "a\nb"),
    ("<article>" + "<div>" * 3000 + "deep", "deep"), ("plain words only", "plain words only"),
    ("<article><p>3 <", "3 <"), ("<article><p>a<", "a<"), ("<article><p>a <2", "a <2"), ("<article><p>a </", "a"), ("<article><p>a <!-", "a"),
])
def test_odd_pages(source, text):
    blocks = html.page_blocks(source)
    article = html.article_text(blocks)
    assert (html.uncovered_text(blocks, html.covered_words([], 6)) if article is None else article) == text


@pytest.mark.parametrize("wrapper", [
    "<div class='layout has-sidebar'>", "<div class='no-comments'>", "<div class='ad-free'>", "<div id='with-nav'>", "<form id='aspnetForm'>",
    "<div class='header'>", "<div class='widget'>", "<form><div class='page'>", "<div role='banner'>"])
def test_wrappers_keep_the_article(wrapper):
    source = f"<nav>menu</nav>{wrapper}<article><div class='article-header'><h1>Head</h1></div><div class='header'>by line</div><p>text</p></article>"
    assert html.article_text(html.page_blocks(source)) == "Head\nby line\ntext"


@pytest.mark.parametrize("wrapper", [
    "<nav>", "<aside>", "<footer>", "<div class='comments'>", "<section id='comments-area'>", "<div class='box sidebar'>", "<div id='comment-12'>",
    "<div hidden>", "<div role='navigation'>", "<div class='Site-Footer'>"])
def test_articles_in_side_parts_are_no_text(wrapper):
    blocks = html.page_blocks(f"<p>page</p>{wrapper}<div><article>other</article></div>")
    assert html.article_text(blocks) is None and html.uncovered_text(blocks, html.covered_words([], 6)) == "page"


@pytest.mark.parametrize(("source", "text"), [
    ("<div class='has-sidebar'><p>a</p></div>", "a"), ("<form><p>a</p><input></form>", "a"), ("<p>a</p><form>name <input></form>", "a"),
    ("<div>a</div><form><p>b</p><nav>c</nav><div>d</div></form>e", "a\nb\nd\ne"), ("<form>x<article>b</article></form>", "b"),
    ("<article>a<form>f<p>g</p></form>b</article>", "a\nb"), ("<div class='cookie-notice'>c</div><p>a</p>", "a"),
    ("<form><div class='ad'>x</div><header>y</header><p>a</p></form>", "a")])
def test_names_and_forms_without_an_article(source, text):
    blocks = html.page_blocks(source)
    article = html.article_text(blocks)
    assert (html.uncovered_text(blocks, html.covered_words([], 6)) if article is None else article) == text


def test_repeats_across_pages_of_a_host_are_no_text(spark):
    menu = "<div>home about us contact imprint terms help</div>"
    story = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    rows = [(i, "http://a.org/" + str(i), f"{menu}<p>{story(i)}</p>") for i in range(5)]
    rows += [(10, "http://b.org/", f"{menu}<p>only page of its host</p>"), (11, None, None), (None, "junk", ""), (12, "http://A.org:80/x", menu)]
    rows += [(20 + i, "http://c.org/", f"<div>home about us contact imprint terms help</div><article><p>same article text on both pages of it</p></article>") for i in range(2)]
    got = {r["page_id"]: r for r in html.extract_text(pages(spark, rows)).collect()}
    assert len(got) == len(rows)
    for i in range(5):
        assert got[i]["text"] == story(i) and got[i]["n_repeated"] == 7
    assert got[10]["text"] == "home about us contact imprint terms help\nonly page of its host" and got[10]["n_repeated"] == 0
    assert [got[i]["text"] for i in (11, None, 12)] == ["", "", ""] and got[12]["row"] == "r" and got[12]["zones"] == 2
    assert got[20]["text"] == got[21]["text"] == "same article text on both pages of it" and got[20]["n_repeated"] == 7
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html.extract_text(pages(spark, [])).count() == 0


def test_copied_pages_keep_their_text(spark):
    menu = "<div>home about us contact imprint terms help</div>"
    story = " ".join(f"word{j}" for j in range(40))
    rows = [(i, f"http://a.org/{i}", f"{menu}<p>{story}</p><div class='ad'>offer {i}</div>") for i in range(3)]  # one page but for the advert
    rows += [(10 + i, f"http://b.org/{i}", f"{menu}<p>{story}</p>") for i in range(4)] + [(20, "http://b.org/x", f"{menu}<p>another page</p>")]
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, rows)).collect()}
    assert [got[i] for i in range(3)] == ["home about us contact imprint terms help\n" + story] * 3
    assert [got[10 + i] for i in range(4)] == [story] * 4 and got[20] == "another page"


def test_blocks_that_a_host_repeats_go_from_its_articles(spark):
    letter, few = "get our weekly letter and never miss a story", "a line that only half of the articles have"
    story = lambda h, i: f"{h}{i} " + " ".join(f"w{i}x{j}" for j in range(30))
    article = lambda *p: "<article>" + "".join(f"<p>{x}</p>" for x in p) + "</article>"
    said = {("a", i): [story("a", i), *([few] if i < 10 else []), letter, "the end"] for i in range(20)}
    said |= {("b", i): [story("b", i), letter] for i in range(9)}  # too few pages to tell
    said |= {("c", i): [" ".join(f"same{j}" for j in range(40)), f"edit {i} of the one story here"] for i in range(20)}  # near copies
    rows = [(n, f"http://{h}.org/{i}", article(*p)) for n, ((h, i), p) in enumerate(said.items())]
    rows += [(len(said) + i, f"http://b.org/again{i}", article(*said["b", 0])) for i in range(30)]  # copies count once
    got = {r["page_id"]: r for r in html.extract_text(pages(spark, rows)).collect()}
    for n, ((h, _), p) in enumerate(said.items()):
        assert got[n]["text"] == "\n".join(x for x in p if h != "a" or x != letter) and got[n]["n_repeated"] == 0
    assert got[len(said)]["text"] == "\n".join(said["b", 0])


@pytest.mark.parametrize("size", [6, 60])
def test_prose_stays_whole_on_a_growing_host(spark, size):
    menu = "<ul><li>home<li>about us<li>contact imprint<li>terms help</ul>"
    foot = lambda i: f"<div>all rights reserved by the makers of this fine site since page {i}</div>"
    quote = "it was the best of times it was the worst of times"
    story = lambda i: f"start{i} {' '.join(f'w{i}x{j}' for j in range(8))} {quote if i < 3 else ''} end{i}"
    rows = [(i, f"http://a.org/{i}", f"{menu}<p>{story(i)}</p>{f'<p>{quote}</p>' if i == 3 else ''}{foot(i)}") for i in range(size)]
    rows.append((size, "http://a.org/both", f"{menu}<p>all rights reserved by the makers of this fine site since page one two three four five six seven</p>"))
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages(spark, rows)).collect()}
    for i in range(size):
        want = [" ".join(story(i).split())] + ([quote] if i == 3 and size > 6 else [])
        assert got[i].split("\n")[: len(want)] == want and "rights" not in got[i] and "home" not in got[i]
    assert got[size].startswith("all rights reserved") and got[size].endswith("six seven")


# --------------------------------------------------------------------- archives


def test_archive_holds_payloads_once_and_reads_back(spark, tmp_path):
    rows = [(3, "u3", "same"), (1, "u%\n1", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n" + "x" * 100_000),
            (None, "u", "same"), (None, "v", "nameless"), (1, "again", "same"), (7, "u", "ü")]
    df = pages(spark, rows).select("page_id", "url", "html", "row")
    folder = str(tmp_path / "archive")
    warc.write_archive(df, folder)
    stored = spark.read.parquet(f"{folder}/payloads")
    assert stored.count() == len({r[2] or "" for r in rows})
    for r in warc.read_records(spark, folder).collect():
        fields, block = warc.parse_record(bytes(r["record"]))
        assert len(block) == int(fields["Content-Length"]) and (fields["WARC-Type"] == "revisit") == ("WARC-Refers-To" in fields)
    got = warc.describe_archive(spark, folder).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((i, u or "") for i, u, _ in rows)
    assert Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == Counter([
        (1, "response", None), (1, "revisit", 1), (2, "revisit", 1), (3, "revisit", 1), (None, "revisit", 1), (4, "response", None),
        (5, "revisit", 4), (6, "response", None), (None, "response", None), (7, "response", None)])
    for r in got:
        if r["page_id"] == 7:
            assert r["payload_bytes"] == 2 and r["payload_digest"] == base64.b32encode(hashlib.sha1("ü".encode()).digest()).decode()


def test_small_payloads_are_all_responses(spark):
    got = warc.archive_round_trip(pages(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")]), min_bytes=3)
    assert sorted((r["page_id"], r["record_type"]) for r in got.collect()) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    assert warc.archive_round_trip(pages(spark, [])).count() == 0


def test_damaged_records_are_found():
    record = warc.record_header(1, 0, "u", 3, warc.base32_sha1(b"abc"), None, None) + b"abc\r\n\r\n"
    assert warc.parse_record(record)[1].endswith(b"abc")
    for bad in (record[:-1], record.replace(b"WARC/1.1", b"WARC/0.9"), record + b"x"):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# --------------------------------------------------------------------- conversations


@pytest.mark.parametrize("text", ["", "plain", "<|im_end|>", "<\\|x", "<\\\\|", "<|<|\\|", "<", "a\n<|im_start|>assistant\nb", "\\n", "<\n|"])
def test_escapes_are_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    formatted, spans = chat.format_turns([(text, text), ("assistant", text), (None, None), ("assistant", text)])
    assert chat.read_turns(formatted) == [(text, text), ("assistant", text), ("", ""), ("assistant", text)]
    assert chat.read_loss(formatted, spans) == text * 2 or text == "assistant"


def test_best_branch_of_reply_trees(spark):
    rng = np.random.default_rng(2)
    nodes, trees = [], {}
    for tree in range(6):
        parents = [None] + [int(rng.integers(0, i)) for i in range(1, 30)]
        scores = [float(s) for s in rng.integers(0, 4, 30)]
        trees[tree] = (parents, scores)
        nodes += [(tree, i, p, "user", f"t{i}", s) for i, (p, s) in enumerate(zip(parents, scores, strict=True))]
    nodes += [(None, 1, None, None, None, None), (None, 2, 1, "assistant", "x", None), (50, 1, 99, "user", "orphan", 1.0), (60, 1, 2, "user", "loop", 1.0), (60, 2, 1, "user", "loop", 1.0)]
    df = spark.createDataFrame(nodes, "tree_id long, node_id long, parent_id long, role string, text string, score double")
    every = defaultdict(dict)
    for r in chat.tree_paths(df, branches=None).collect():
        every[r["tree_id"], r["leaf_id"]][r["depth"]] = r["node_id"]
    ranked = {(r["tree_id"], r["branch"]): r["leaf_id"] for r in chat.tree_paths(df, branches=2).collect()}
    for tree, (parents, scores) in trees.items():
        want = {}
        for leaf in set(range(30)) - set(parents):
            path = [leaf]
            while parents[path[-1]] is not None:
                path.append(parents[path[-1]])
            want[leaf] = path[::-1]
            assert [every[tree, leaf][d] for d in range(1, len(path) + 1)] == want[leaf]
        order = sorted(want, key=lambda x: (-sum(scores[i] for i in want[x]) / len(want[x]), -len(want[x]), x))
        assert [ranked[tree, 1], ranked[tree, 2]] == order[:2]
    assert every[None, 2] == {1: 1, 2: 2} and every[50, 1] == {1: 1} and not any(t == 60 for t, _ in every)


def test_conversations_read_back(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<|im_end|>\n"), (1, 2, "assistant", "é" * 5), (1, 2, "assistant", "é" * 5), (1, 3, "assistant", None),
            (2, None, "user", "first"), (2, 0, None, None), (None, 0, "assistant", "nameless"), *[(3, i, "user", "y" * 10) for i in range(300)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_digests.digests(chat.format_conversations(chat.chains(turns))).collect()}
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        groups[r[0]].append((r[2] or "", r[3] or ""))
    for conv, told in groups.items():
        loss = "".join(t for role, t in told if role == "assistant")
        assert got[conv]["n_turns"] == len(told) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in told).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, path_score int")
    assert chat.format_conversations(chat.chains(empty)).count() == 0


# --------------------------------------------------------------------- vectors


def odd_vectors(spark, extra=()):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(150):
        rows.append((i, [float(x) for x in rng.normal(size=16)], i % 3))
    for i in range(60):  # near copies, all of one cluster
        rows.append((200 + i, [float(x + 0.02 * rng.normal()) for x in rows[5][1]], 2))
    rows += [(300 + i, rows[7][1], 1) for i in range(5)] + [(310, rows[7][1], None), (311, None, 1), (312, [0.0] * 16, 1), (313, [], 1),
             (314, [1.0, None], 1), (315, [float("nan")] * 16, 1), (316, [float("inf")] + [0.0] * 15, 1), (320, [1.0, 2.0], 1),
             (340, [2.0, 4.0], 1), (None, rows[7][1], 1), (360, [1e150] * 3, 0), (361, [1e150] * 3, 0), *extra]
    return spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<double>, label int, cls string, links int"), rows


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("block", [1024, 16])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(crosspoly, "BLOCK", block)
    df, rows = odd_vectors(spark)
    got = {r["vec_id"]: r for r in crosspoly.linked_vectors(df, 0.93).collect()}
    assert len(got) == len(rows)
    usable = [good(r[1]) and any(r[1]) and r[2] is not None for r in rows]
    near = defaultdict(set)
    for i, j in itertools.combinations(range(len(rows)), 2):
        if usable[i] and usable[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
            a, b = (np.array(rows[k][1]) / max(map(abs, rows[k][1])) for k in (i, j))
            if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= 0.93:
                near[i].add(j)
                near[j].add(i)
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[k][0] for k in seen if rows[k][0] is not None), default=None)
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"]) == (len(near[i]), least)
        assert got[r[0]]["kept"] == (r[0] is not None and r[0] == least) and got[r[0]]["cls"] == "c"


def test_recall_near_the_threshold():
    rng = np.random.default_rng(9)
    a = rng.normal(size=(4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=(4000, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = rng.uniform(0.93, 0.97, (4000, 1))
    b = cosine * a + np.sqrt(1 - cosine**2) * b
    label = np.zeros(4000, dtype=np.int64)
    keys = [crosspoly.bucket_keys(x, label, crosspoly.TABLES, crosspoly.HASHES, crosspoly.PROBES, 10).reshape(4000, -1) for x in (a, b)]
    met = np.mean([bool(set(x) & set(y)) for x, y in zip(*keys, strict=True)])
    assert met >= 0.9


def test_hadamard_is_orthogonal():
    h = crosspoly.hadamard(np.eye(32))
    assert np.allclose(h @ h.T, np.eye(32)) and np.allclose(np.abs(h), 1 / np.sqrt(32))


def test_no_vectors(spark):
    df, _ = odd_vectors(spark)
    assert crosspoly.linked_vectors(df.limit(0)).count() == 0
    assert mtree.top_inner_products(df.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [(32, 4096, 256, 512, 16384), (4, 20, 8, 7, 5)])
def test_top_k_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("ROOTS", "SUBTREE", "PAGE", "QUERIES", "QUERY_BLOCK"), sizes, strict=True):
        monkeypatch.setattr(mtree, name, value)
    df, rows = odd_vectors(spark, extra=[(400, [3.0] * 16, 0), (400, [2.0] * 16, 0), (420, [1.0] * 16, 0), (421, [4.0] * 16, 0),
                                         (421, [0.5] * 16, 0), (421, [0.5] * 16, 0)])
    whole = [(i, [math.floor(64 * c) for c in v]) for i, v, _ in rows if i is not None and good(v) and i not in (360, 361)]
    got = defaultdict(list)
    df = df.where("vec_id is null or vec_id not in (360, 361)")
    for r in mtree.top_inner_products(df, 20, 20, roots=sizes[0]).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = defaultdict(list)
    for n, (q, x) in enumerate(whole):  # every row is a query of its own, and a candidate of all other rows
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for m, (i, y) in enumerate(whole) if m != n and len(y) == len(x))[:20]
            want[q] += [(r + 1, i, -s) for r, (s, i) in enumerate(found)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}
    ids = [v for _, v, _ in got[420]]
    assert ids.count(421) == 3 and ids.count(400) == 2 and min(got[420]) == (1, 421, 64 * 256 * 16)
    assert len(got[400]) == 2 * min(20, len(whole) - 1 - sum(len(y) != 16 for _, y in whole))


def test_tree_passes_pages_over():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 8)) * 1000
    x = np.rint(np.repeat(centres, 200, axis=0) + rng.normal(size=(4000, 8)) * 20).astype(np.int64)
    reach = float((x * x).sum(axis=1).max())
    tree = mtree.Tree(np.arange(4000), x, mtree._lift(x[:1], reach)[0], reach)
    rows, ids, score = tree.search(np.arange(0, 4000, 100), x[::100], np.full(40, mtree._NONE), 5)
    all_scores = x[::100] @ x.T
    all_scores[np.arange(40), np.arange(0, 4000, 100)] = np.iinfo(np.int64).min
    assert sorted(score.tolist()) == sorted(np.sort(all_scores, axis=1)[:, -5:].ravel().tolist())
    assert tree.compared < 0.8 * 40 * 4000


# --------------------------------------------------------------------- pieces


@pytest.fixture(scope="module")
def vocab():
    try:
        return pieces.load_vocabulary(TOKENIZER)
    except OSError:
        pytest.skip("vocabulary file absent")


def all_segmentations(text, vocab):
    def rest(p):
        if p == len(text):
            yield ()
        for i in vocab.normal:
            if text.startswith(vocab.pieces[i], p):
                for r in rest(p + len(vocab.pieces[i])):
                    yield (i, *r)

    found = list(rest(0))
    logs = np.array([sum(vocab.weights[i] for i in s) for s in found])
    return dict(zip(found, np.exp(logs - np.logaddexp.reduce(logs)), strict=True))


def test_draws_follow_the_distribution_without_replacement(vocab):
    known, n = all_segmentations(b" hand a", vocab), 6000
    drawn = pieces.sample_segmentations([b"hand a"] * n, np.arange(n, dtype=np.int64), vocab, 3)
    first, second = (Counter(tuple(d[i][0].tolist()) for d in drawn) for i in (0, 1))
    for s, p in known.items():
        assert abs(first[s] / n - p) < 0.03
        assert abs(second[s] / n - sum(q * p / (1 - q) for t, q in known.items() if t != s)) < 0.03
    for d in drawn:
        assert len({tuple(x[0].tolist()) for x in d}) == 3 and d[0][2] >= d[1][2] >= d[2][2]
        assert all(abs(math.exp(x[1]) - known[tuple(x[0].tolist())]) < 1e-9 for x in d)
    # weighted by the inverse inclusion scores, probabilities add up to 1 on average
    assert abs(np.mean([sum(math.exp(x[1] - x[3]) for x in d) for d in drawn]) - 1) < 0.02


def test_all_segmentations_come_when_asked_for(vocab):
    known = all_segmentations(b" there", vocab)
    (drawn,) = pieces.sample_segmentations([b"there"], np.array([5], dtype=np.int64), vocab, len(known) + 5)
    assert len(drawn) == len(known) and drawn[0][3] == 0.0  # the tiny ones too: what is left is summed, not 1 - p
    assert len({tuple(x[0].tolist()) for x in drawn}) == len(drawn)
    assert min(known.values()) < 1e-12


def test_left_beside_known_ones(vocab):
    known = all_segmentations(b" there", vocab)
    lattice = pieces.build_lattice([b" there"], vocab)

    def edges_of(ids):
        state, out = int(lattice.start[0]), []
        for i in ids:
            (e,) = [e for e in range(int(lattice.first[state]), int(lattice.first[state] + lattice.count[state])) if lattice.piece[e] == i]
            out.append(e)
            state = int(lattice.to[e])
        return out

    order = sorted(known, key=known.get, reverse=True)
    for m in (1, 2, 5, len(order) - 1, len(order)):
        want = sum(known[s] for s in order[m:])
        assert abs(pieces.left_beside(lattice, 0, [edges_of(s) for s in order[:m]]) - want) <= 1e-15 + 1e-9 * want


def test_parts_are_cut_as_the_pattern_says():
    texts = [b"", b"  x ", b"a\n\nb\n", b"\n", b" ", b"the  the\tcat \n  sat", "日 本\n𝄞".encode(), b"", b"\xff \x00z"]
    parts, counts = pieces.split_parts(texts)
    want = [re.findall(rb"\n| +[^ \n]*|[^ \n]+", b" " + t) if t else [] for t in texts]
    assert parts.to_pylist() == [p for w in want for p in w] and counts.tolist() == [len(w) for w in want]
    assert [len(x) for x in pieces.split_parts([b"", b""])] == [0, 2]


def test_other_edges_are_summed_once_and_only_for_drawn_edges(vocab):
    lattice = pieces.build_lattice([b" there", b" hand", b"\n"], vocab)
    state = np.repeat(lattice.start, 2)  # every edge is asked for twice
    edge = lattice.first[state]
    want = [sum(lattice.p[f + 1 : f + n].tolist()) for f, n in zip(edge, lattice.count[state], strict=True)]
    assert lattice.beside(edge, state).tolist() == want
    assert np.isfinite(lattice.others).sum() == 3
    assert lattice.beside(edge[:1], state[:1]).tolist() == want[:1]


def test_no_edge_is_searched_again_for_its_first_two_bytes(vocab):
    pair = int(vocab.pairs[ord("t") * 256 + ord("h")])
    assert pair == int(vocab.child(np.array([int(vocab.roots[ord("t")]) * 256 + ord("h")]))[0]) and vocab.ends[pair] >= 0


def test_texts_come_back(spark, vocab, monkeypatch):
    monkeypatch.setattr(pieces, "CHUNK", 40)
    texts = ["", None, "  x ", "a\n\nb\n", "▁a▁ b", "é\tñ ﬁ Ａ\x00z", "    ", "日本語𝄞", "x" * 3000, "word " * 2000, "the", "the"]
    rows = [(i if i else None, t, "i", 7, "d") for i, t in enumerate(texts)] + [(10, "the", "i", 7, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, raw string, digest int, decoded string")
    texts_back = pieces.decode_samples(pieces.encode_samples(docs.drop("decoded"), TOKENIZER, k=2), TOKENIZER).select("doc_id", "decoded").collect()
    assert {tuple(r) for r in texts_back} == {(i, t or "") for i, t, *_ in rows}
    got = pieces.checked_samples(docs, TOKENIZER, k=3).collect()
    assert all(r["round_trip"] and r["raw"] == "i" and r["digest"] == 7 and len(r["ids"]) == r["n_pieces"] for r in got)
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert [(r["sample"], r["ids"], r["log_inclusion"]) for r in got if r["doc_id"] == 1] == [(1, [], 0.0)]
    same = [(r["sample"], tuple(r["ids"]), r["perturbed"]) for r in got if r["doc_id"] == 10]
    assert Counter(same).most_common()[-1][1] == 2  # repeated rows draw alike
    assert pieces.checked_samples(docs.limit(0), TOKENIZER).count() == 0
