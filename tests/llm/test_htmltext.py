import random
import time

from helixmill.llm import htmltext


def text(page, gone=frozenset()):
    return htmltext.text_of(*htmltext.parse(page), gone)


def test_blocks_spaces_and_references():
    assert text("<p>a &amp;  b\n c&nbsp;d<br>e</p><p>f<b>g</b> <i>h</i></p>i") == "a & b c d e\nfg h\ni"
    assert text("<ul><li>one<li>two</ul><dl><dt>t<dd>d</dl><h2>x</h2>") == "one\ntwo\nt\nd\nx"
    assert text("<p>a<p>b<div>c<p>d</div>e") == "a\nb\nc\nd\ne"
    assert text("<p><b>a<br><p>b</p>") == "a\nb"
    assert text("a < b and 3<4 &lt;p&gt; &#233;&#x2014;&bogus; &am") == "a < b and 3<4 <p> é—&bogus; &am"
    assert text("") == "" and text("<div><p> </p></div>") == "" and text("<p title='a>b'>x</p><p") == "x"
    assert text("<table><tr><td>a<td>b<tr><td>c</table>") == "a b\nc"


def test_what_is_no_content():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var t="</p>";</script>
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> -->
    <div class="ad">Buy</div><div id="cookie-notice">We use</div><div class="sideBar">no</div><p>kept</p><form>name <input value="x"></form>
    <section class="comments"><article>first!</article></section><div hidden>h</div><div style="display: none">n</div><div role="alert">!</div>
    <span class="advert">inline <span>ad</span></span><p class="shared-reading headline">also</p><footer>&copy; x</footer></body>"""
    assert text(page) == "kept\nalso"
    inside = "<p>out</p><main><p>lead</p><article><header><h1>H</h1></header><p>body</p><div class='related'>r</div><aside>a</aside></article></main>"
    assert text(inside) == "H\nbody"
    assert text("<p>out</p><div role='main'><p>in</p></div>") == "in"


def pages(spark):
    rows = []
    for k in range(40):
        host = "a.example" if k % 4 else "b.example"
        rows.append((k, f"http://{host}/{k}", f"<div><p>Welcome to the site</p></div><article><p>Story {k}</p><p>Common line</p><div><p>Read more stories</p></div></article>" if host[0] == "a" else f"<div><p>Own menu {host}</p></div><p>Text {k}</p><p>Even {k % 2}</p>"))
    rows += [(100, None, "<p>lone</p>"), (101, "http://a.example/", None), (102, "http://c.example/", "<p>x</p>"), (102, "http://c.example/", "<p>x</p>"), (103, "http://d.example", "<p>long</p>" * 20000)]
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")


def test_templates_of_a_host_go(spark, monkeypatch):
    df = pages(spark)
    for bound in (50_000, 0):
        monkeypatch.setattr(htmltext, "BROADCAST_ROWS", bound)
        got = {r.page_id: r for r in htmltext.digests(df).collect()}
        assert len(got) == 44 and htmltext.digests(df).count() == 45
        for k in range(40):
            # inside an article a share of nearly all pages is template; outside a fifth is
            assert got[k].text == (f"Story {k}" if k % 4 else f"Text {k}"), k
        assert got[100].text == "lone" and got[101].text == "" and got[102].text == "x" and got[103].text.count("\n") == 19999
        assert all(r.n_chars == len(r.text) for r in got.values())


def test_copies_of_an_article_keep_their_text(spark):
    page = "<nav>n</nav><article><h1>Same</h1><p>Copied story</p></article>"
    rows = [(k, "http://h.example/", page if k < 12 else page.replace("story", f"story {k}").replace("Same", f"Other {k}")) for k in range(30)]
    got = htmltext.digests(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got if r.page_id < 12} == {"Same\nCopied story"}
    assert htmltext.digests(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).collect() == []


def test_copies_count_once_and_no_page_loses_all_its_text(spark):
    page = "<article><h1>Same</h1><p>Copied story</p></article>"
    rows = [(k, "http://h.example/", page) for k in range(12)] + [(20 + k, "http://plain.example/", "<div><p>One text</p><p>Two</p></div>") for k in range(15)]
    rows += [(40 + k, "http://h.example/", page.replace("story", f"story {k}")) for k in range(5)]
    rows += [(60 + k, "http://m.example/", f"<p>Menu</p><p>Own {k}</p>" if k else "<p>Menu</p>") for k in range(12)]
    got = {r.page_id: r.text for r in htmltext.digests(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[k] for k in range(12)} == {"Same\nCopied story"} and {got[20 + k] for k in range(15)} == {"One text\nTwo"}
    assert got[41] == "Same\nCopied story 1" and got[60] == "Menu" and got[61] == "Own 1"


def test_the_content_outweighs_words_and_tags():
    assert text("<article><h1>Title</h1><div class='menu-free notice-period'><p>The whole story is here.</p></div></article>") == "Title\nThe whole story is here."
    assert text("<article><p>teaser</p></article><div class='content'><p>a long story</p></div>") == "teaser\na long story"
    for page in ('<body class="has-sidebar"><p>all of it</p></body>', '<article class="comments-open"><p>all of it</p></article>', '<main id="content-with-nav"><p>all of it</p></main>'):
        assert text(page) == "all of it"
    assert text("<article><p>one two</p></article><div class='comments'><p>many more words than the article</p></div>") == "one two"
    assert text("<p>a <span class='ad'>buy</span> b</p><span class='promo'><div>now</div></span><p>c</p>") == "a b\nc"
    assert text("<p>plain</p><nav>" + "<a href='/'>many links here</a>" * 9 + "</nav>") == "plain" and text("<nav>only</nav>") == ""


def test_recurrence_removes_menus_and_lines_of_a_host(spark):
    def page(k, host, n):
        own = " ".join(f"w{k}x{j}" for j in range(30))
        share = "<p>Share this</p>" if k % 2 else ""
        return (k, f"http://{host}/{k}", f"<div><ul>{''.join(f'<li><a href=x>link {k} {j}</a></li>' for j in range(k % 4 + 2))}</ul></div><div class='text'><p>{own}</p>{share}<p>In all of {n}</p></div>")

    rows = [page(k, "big.example", 100) for k in range(100)] + [page(k, "small.example", 8) for k in range(100, 108)] + [page(200, "lone.example", 1)]
    got = {r.page_id: r.text for r in htmltext.digests(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in [*range(100), *range(100, 108)]:
        assert got[k] == " ".join(f"w{k}x{j}" for j in range(30)) + ("\nShare this" if k >= 100 and k % 2 else ""), k
    assert got[200].startswith("link 200 0\n") and got[200].endswith("In all of 1")


def brute(rows):
    """Plain loops over trees (tag, class, children): the same rules, without Spark, prefix sums or a parser."""
    hosts = {}
    for _, host, tree in rows:
        hosts.setdefault(host, []).append(tree)

    def leaves(t):
        return [t] if isinstance(t, str) else [x for c in t[2] for x in leaves(c)]

    def whole(t):
        return t if isinstance(t, str) else (t[0], *map(whole, t[2]))

    def shape(t):
        if isinstance(t, str):
            return "T"
        kinds = [shape(c) for c in t[2]]
        return (t[0], t[1], *(k for i, k in enumerate(kinds) if not i or k != kinds[i - 1]))

    def walk(t, inside=False):
        """Every element with whether it lies in the content."""
        if not isinstance(t, str):
            inside = inside or t[0] in ("article", "main")
            yield t, inside
            for c in t[2]:
                yield from walk(c, inside)

    words = lambda ts: sum(len(x.split()) for x in ts)
    linked = lambda t: words(leaves(t)) if t[0] == "menu-links" else sum(linked(c) for c in t[2] if not isinstance(c, str))
    out = {}
    for page, host, tree in rows:
        pages = list({tuple(leaves(t)): t for t in hosts[host]}.values())
        lone = {id(t): not any(i for _, i in walk(t)) for t in pages}
        own_lone = not any(i for _, i in walk(tree))
        gone = set()
        every = leaves(tree)
        for node, inside in walk(tree):
            holders = [t for t in pages if any(whole(x) == whole(node) for x, _ in walk(t))]
            within = any(i or lone[id(t)] for t in holders for x, i in walk(t) if whole(x) == whole(node))
            n = len(holders)
            recurs = n >= 3 and (n >= 8 and 2 * n >= len(pages) if within else 5 * n >= len(pages))
            if not inside and 2 * linked(node) >= words(leaves(node)):
                like = [[x for x, i in walk(t) if not i and shape(x) == shape(node) and 2 * linked(x) >= words(leaves(x))] for t in pages]
                n = sum(map(bool, like))
                recurs = recurs or (n >= 3 and 2 * n >= len(pages) and 2 * sum(max(words(leaves(x)) for x in xs) for xs in like if xs) < sum(words(leaves(t)) for t in pages))
            if recurs:
                gone.add(id(node))

        kept = []

        def keep(t, lost, level, at):
            """Texts with whether they are lost and their level; the places of each element's texts."""
            if isinstance(t, str):
                kept.append((t, lost, level))
                return
            level = max(level, {"article": 2, "main": 1}.get(t[0], 0))
            first = len(kept)
            for c in t[2]:
                keep(c, lost, level, at)
            at.append((t, first, len(kept)))

        places = []
        keep(tree, False, 0, places)
        levels = [x[2] for x in kept]
        wholes = [w for w in ([k for k, v in enumerate(levels) if v >= least] for least in (0, 1, 2)) if w]
        lost = set()
        for t, a, b in places:
            if id(t) in gone and not any(a <= w[0] and w[-1] < b for w in wholes):
                lost.update(range(a, b))
        left = [k for k in range(len(kept)) if k not in lost] or list(range(len(kept)))
        for least in (2, 1):
            some = [k for k in left if levels[k] >= least]
            if some and 2 * words(kept[k][0] for k in some) >= words(kept[k][0] for k in left):
                left = some
                break
        out[page] = "\n".join(kept[k][0] for k in left)
        assert every == [x[0] for x in kept] and own_lone in (True, False)
    return out


def markup(t):
    if isinstance(t, str):
        return t
    if t[0] == "menu-links":
        return "<div class='l'>" + "".join(f"<div><a href='/'>{c[2][0]}</a></div>" for c in t[2]) + "</div>"
    return f"<{t[0]} class='{t[1]}'>" + "".join(markup(c) for c in t[2]) + f"</{t[0]}>"


def test_matches_plain_loops(spark):
    rng = random.Random(6)
    rows = []
    for host, n in (("a.example", 24), ("b.example", 9), ("c.example", 4), ("d.example", 1)):
        fixed = [("p", "x", [f"fixed {host} {j}"]) for j in range(4)]
        for _ in range(n):
            k = len(rows)
            say = lambda m: ("p", "x", [" ".join(f"w{rng.randrange(9999)}" for _ in range(m))])  # noqa: B023, E731
            story = [say(rng.choice([1, 3, 9])) for _ in range(rng.choice([1, 2, 4]))] + rng.sample(fixed, rng.choice([0, 1, 2]))
            rng.shuffle(story)
            links = ("menu-links", "l", [("menu-links", "", [f"go {k} {j}"]) for j in range(rng.choice([2, 3]))])
            parts = [links, ("section", "s", [rng.choice(fixed)]), (rng.choice(["article", "main", "div"]), "c", story), say(2)]
            tree = ("div", "page", [p for p in parts if rng.random() < 0.85] or [say(1)])
            rows.append((k, host, tree))
            if rng.random() < 0.2:
                rows.append((len(rows), host, tree))
    flat = lambda t: t if isinstance(t, str) else (t[0], t[1], [x for c in t[2] for x in ([flat(c)])])
    df = spark.createDataFrame([(k, f"http://{h}/{k}", markup(flat(t))) for k, h, t in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltext.digests(df).collect()}
    want = brute(rows)
    assert {k: v for k, v in got.items() if v != want[k]} == {} and any(len(v.split()) < len(markup(t).split()) for (k, _, t), v in zip(rows, got.values()))


def test_broken_pages_take_time_in_proportion():
    for piece in ("<p title='it", '<span class="ad">', "<div>", "<ul><li>", "</p></div>", "<!", "<!-- ", "<a b='", "<x y=\"'>", "< <", "<article><div class='menu'>x"):
        times = []
        for n in (4000, 16_000):
            began = time.process_time()
            htmltext.text_of(*htmltext.parse(piece * n))
            times.append(time.process_time() - began)
        assert times[1] < 10 * times[0] + 0.2, (piece, times)
