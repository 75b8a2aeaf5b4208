import random
from urllib.robotparser import RobotFileParser

import duckdb
import pytest
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions import present as P
from ravelin.functions import urls as U
from ravelin.operators import history, providers, web
from ravelin.operators.ranks import running
from ravelin.operators.versions import Snapshots
from ravelin.plans import catalogue
from ravelin.streaming import ingest


def column(spark, values, made):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(made(F.col("v"))).collect()]


def test_urls(spark):
    assert column(spark, ["http://a.b/c/?q#f", "https://U@A.b:1/", "https://a.b", "http://a.b/x//"], U.normalised) == ["http://a.b/c", "https://U@A.b:1", "https://a.b", "http://a.b/x"]
    assert column(spark, ["http://a", "ftp://a", "https:///p", "x", None], U.valid_url) == [True, False, False, False, False]
    bases = ["https://h/", "https://h/openai/v1/", "https://h/openai/v1/chat/completions", "https://h/openai/v1/x", "", None]
    assert column(spark, bases, U.models_url) == ["https://h/openai/v1/models"] * 4 + ["", ""]


def test_page_reading(spark):
    html = "<title>T &amp; x</title><link rel='Canonical' href='/c'><body><nav><p>menu</p><a href='/n'>n</a></nav><article><h1>Head</h1><div><p>One <b>two</b></p></div><form><p>f</p></form></article><p>out</p></body>"
    assert web.read_page(html) == ("Head\n\nOne two", "T & x", "/c", [])
    assert web.read_page("<main><p>a</p></main><p>b</p>")[0] == "a" and web.read_page("<p>b</p>")[0] == "b" and web.read_page(None) == ("", "", None, [])
    lines = "<body>\n<main>\n<p>\n one\n<b>two</b> \n</p>\n<p>don&#8217;t &eacute;<p>inner</p></main><article><nav><title>no</title></nav><h2>\t</h2></article>"
    assert web.read_page(lines) == ("", "", None, []) and web.read_page(lines.replace("article", "section"))[0] == "one two\n\ndon\u2019t \u00e9 inner\n\ninner"
    assert web.read_page("<a href='../x'>u</a><a href=' '>b</a><a>c</a><link rel=canonical><link rel=canonical href=/later>")[2:] == (None, ["../x"])
    pages = spark.createDataFrame([(1, "https://a.b/d/x?y", html.replace("Head", "<a href='../up?q'>u</a><a href='s#f'>s</a><a href='http://[x'>bad</a>")), (2, "https://a.b/z", None), (3, None, "<p>p<a href='r'>r</a>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in web.page_texts(pages).collect()}
    assert (got[1].canonical_url, got[1].title, got[2].title, got[2].content, got[3].content, got[3].links) == ("https://a.b/c", "T & x", "https://a.b/z", "", "p r", [])
    assert got[1].links == ["https://a.b/s", "https://a.b/up"]
    assert web.page_texts(pages.limit(0)).count() == 0
    deep = web.read_page("<p>" * 3000 + "end")[0]
    assert deep.count("end") == 3000


def queue_crawl(root, site, forbidden, config, skipped=None):
    """A crawl by a plain queue over pages of url: (canonical, title, content, links), or a string: why there is none. What is skipped goes to the list."""
    queue, seen, texts, out, total = [(root, 0)], set(), set(), [], 0
    skipped = [] if skipped is None else skipped
    while queue and len(out) < config.crawl_pages:
        url, depth = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        if forbidden(url) or isinstance(site.get(url, "missing"), str):
            skipped.append((root, depth, url, "robots" if forbidden(url) else site.get(url, "missing")))
            continue
        canonical, title, content, links = site[url]
        if (canonical != url and canonical in seen) or not content or content in texts:
            continue
        texts.add(content)
        if total + len(content) > config.crawl_chars:
            break
        out.append((root, len(out) + 1, depth, canonical, title, content))
        total += len(content)
        seen.add(canonical)
        if depth < config.crawl_depth and len(out) < config.crawl_pages:
            queue += [(link, depth + 1) for link in links if link not in seen]
    return out


def test_crawl_equals_a_queue(spark):
    rng = random.Random(5)
    rows, robots = [], []
    for host in range(9):
        origin = f"https://h{host}.x"
        for n in range(14):
            links = "".join(f"<a href='/p{rng.randrange(16)}?q={k}#f'>l</a>" for k in range(rng.randrange(5))) + "<a href='https://h0.y/p1'>off</a>"
            named = f"<link rel=canonical href='/p{rng.randrange(16)}'>" if rng.random() < 0.4 else ""
            text = rng.choice([f"page {n} " * rng.randrange(1, 30), "same text", f"own {n}", ""])
            status, kind, answered = rng.choice([(200, "text/html; charset=x", None)] * 9 + [(404, "text/html", None), (200, "application/pdf", None), (200, "Text/HTML", f"{origin}/p{n}/moved"), (200, "text/html", "https://else.where/p1?x")])
            rows.append((host * 100 + n, f"{origin}/p{n}" + ("?x=1" if n % 5 == 0 else ""), f"{named}<article><p>{text}</p>{links}</article>", status, kind, answered))
        robots.append((f"h{host}.x", "User-agent: *\nAllow: /p11\nDisallow: /p1\n" if host % 3 == 0 else "User-agent: else\nDisallow: /", 200 if host % 2 == 0 else 404))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, status int, content_type string, answered string")
    kinds = {r[1].split("?")[0]: r for r in rows}
    read = {r.page_id: (r.canonical_url, r.title, r.content, r.links) for r in web.page_texts(pages.withColumn("url", F.coalesce("answered", "url"))).collect()}
    site = {}
    for url, (page_id, _, _, status, kind, answered) in kinds.items():
        why = "status" if status != 200 else "content_type" if "html" not in kind.lower() else "origin" if answered and "else.where" in answered else None
        site[url] = why or read[page_id]
    closed = lambda url: any(url.startswith(f"https://h{h}.x/p1") and not url.startswith(f"https://h{h}.x/p11") for h in (0, 6))  # noqa: E731  the file of h3 answers 404
    roots = [f"https://h{h}.x/p{p}" for h in range(9) for p in (0, 2)]
    for depth, most, chars in ((3, 8, 20000), (1, 100, 1000)):
        config = EngineConfig(crawl_depth=depth, crawl_pages=most, crawl_chars=chars)
        want, skipped = [], []
        for r in roots:
            want += queue_crawl(r, site, closed, config, skipped)
        out = web.crawl_outcomes(spark.createDataFrame([(r,) for r in [*roots, "ftp://h1.x/", "https://none.x/"]], "root string"), pages, spark.createDataFrame(robots, "host string, robots string, status int"), config)
        assert sorted(tuple(r) for r in web.taken_pages(out).select("root", "visit", "depth", "url", "title", "content").collect()) == sorted(want)
        skipped = [(r, d, "https://else.where/p1" if why == "origin" else u, why) for r, d, u, why in skipped] + [("https://none.x/", 0, "https://none.x", "missing")]
        assert sorted(tuple(r) for r in web.skipped_addresses(out).select("root", "depth", "address", "reason").collect()) == sorted(skipped)
    typed = pages.withColumn("content_type", F.lit("application/pdf"))
    none = spark.createDataFrame([], "host string, robots string")
    assert web.crawl_pages(spark.createDataFrame([(roots[0],)], "root string"), typed, none).count() == 0
    assert web.crawl_pages(spark.createDataFrame([], "root string"), pages, none).count() == 0


def test_chains_of_a_level_are_settled_in_order(spark):
    """Each page names the next one canonical: every second goes."""
    rows = [(k, f"https://a.b/p{k:02d}", f"<link rel=canonical href='/p{k + 1:02d}'><p>text {k}</p>" + ("".join(f"<a href='/p{j:02d}'>x</a>" for j in range(1, 13)) if k == 0 else "")) for k in range(14)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    config = EngineConfig(crawl_depth=1, crawl_pages=50)
    read = {r.url: (r.canonical_url, r.title, r.content, r.links) for r in web.page_texts(pages).collect()}
    got = web.crawl_pages(spark.createDataFrame([("https://a.b/p00",)], "root string"), pages, spark.createDataFrame([], "host string, robots string"), config)
    assert sorted(tuple(r) for r in got.select("root", "visit", "depth", "url", "title", "content").collect()) == queue_crawl("https://a.b/p00", read, lambda u: False, config)


def test_robots_rules_equal_the_parser(spark):
    rng = random.Random(8)
    paths = ["/", "/a", "/a/", "/a/b", "/b?q=1", "/%7Eme/x", "/~me/x", "/\u00e9t\u00e9", "/a%2fb", "", "/x;p=1", "/a b"]
    files = ["", "User-agent: *\nDisallow:\n", "User-agent: *\nDisallow: *\n", "Disallow: /a\n", f"User-agent: {web.AGENT}\nUser-agent: other\nAllow: /a/b\nDisallow: /a\n\nUser-agent: *\nDisallow: /", "nonsense\n\nuser-agent: *\ndisallow: /%7eme\ncrawl-delay: 2"]
    for _ in range(25):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            lines.append("User-agent: " + rng.choice(["*", "ravelin", "RavelinBot/2", "else"]))
            lines += [rng.choice(["Allow: ", "Disallow: "]) + rng.choice(paths) for _ in range(rng.randrange(4))] + [""] * rng.randrange(2)
        files.append("\n".join(lines))
    urls = [(h, f"https://h{h}.x{p}") for h in range(len(files) + 1) for p in paths]
    pages = spark.createDataFrame([(k, u) for k, (_, u) in enumerate(urls)] + [(10**6, None)], "page_id long, url string")
    robots = spark.createDataFrame([(f"h{h}.x", t) for h, t in enumerate(files)] + [(None, "User-agent: *\nDisallow: /")], "host string, robots string")
    want = {10**6}
    for k, (h, u) in enumerate(urls):
        parser = RobotFileParser()
        parser.parse(files[h].splitlines() if h < len(files) else [])
        parser.modified()
        if parser.can_fetch(web.AGENT, u):
            want.add(k)
    assert {r.page_id for r in web.allowed(pages, robots).collect()} == want


def test_running_totals_of_large_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aaaaaab"), k, rng.randrange(9)) for k in range(3000)]
    table = spark.createDataFrame(rows, "g string, k long, x long").repartition(6)
    want, at = set(), {}
    for g, k, x in rows:
        n, t = at.get(g, (0, 0))
        at[g] = (n + 1, t + x)
        want.add((g, k, *at[g]))
    assert {(r.g, r.k, r.n, r.total) for r in running(table, ["g"], ["k"], "x").collect()} == want
    assert {(r.g, r.k, r.n, r.total) for r in running(table, ["g"], ["k"], "x", 40).collect()} == {w for w in want if w[2] <= 40}
    plan = running(table, ["g"], ["k"], "x", 40)._jdf.queryExecution().toString()
    assert "windowspecdefinition(g#" not in plan.replace(" ", "") or "_part" in plan


def test_a_crawl_is_ingested(spark):
    rows = [(k, f"https://a.b/p{k}", f"<title>T{k}</title><p>Alpha text number {k}</p><a href='/p{k + 1}'>x</a><a href='/gone'>y</a>") for k in range(4)]
    pages, none = spark.createDataFrame(rows, "page_id long, url string, html string"), spark.createDataFrame([], "host string, robots string")
    out = web.crawl_outcomes(spark.createDataFrame([("https://a.b/p0",)], "root string"), pages, none, EngineConfig(crawl_depth=2))
    store = Snapshots(spark)
    with pytest.raises(PermissionError):
        ingest.ingest_crawl(store, out, 0)
    told = ingest.ingest_crawl(store, out, 0, EngineConfig(allow_urls=True, embedding_dim=4))
    assert told.pop("latency_ms") > 0 and told == {"pages": 3, "pages_ingested": 3, "chunks": 3, "mentions": 9, "vectors": 3, "skipped": 1}
    assert {(r.doc_id, r.title) for r in store.read("documents").collect()} == {(f"https://a.b/p0 https://a.b/p{k}", f"T{k}") for k in range(3)}


def test_links_duplicates_budget_robots_and_crawl(spark):
    html = "<nav><a href='/n'>n</a></nav><a class='x' href='/m?q'>m</a><a href=\"http://other/\">o</a><a href=''>e</a>"
    pages = spark.createDataFrame([(1, "https://a.b/x", html), (2, "https://a.b/y", None)], "page_id long, url string, html string")
    assert [(r.page_id, r.link) for r in web.page_links(pages).collect()] == [(1, "https://a.b/m")]
    texts = spark.createDataFrame([(1, "h", "same"), (2, "h", "same"), (3, "h", "x" * 1200), (4, "h", "y"), (5, "h", "")], "page_id long, host string, content string")
    kept = web.first_by_content(texts)
    assert sorted(r.page_id for r in kept.collect()) == [1, 3, 4]
    assert [r.page_id for r in web.within_budget(kept, EngineConfig(crawl_chars=1000)).collect()] == [1]
    rules = spark.createDataFrame([("a.b", "User-agent: *\nDisallow: /x")], "host string, robots string")
    assert [r.page_id for r in web.allowed(pages, rules).collect()] == [2]
    links = spark.createDataFrame([("r", "a"), ("a", "b"), ("a", "r"), ("b", "c")], "source string, target string")
    roots = spark.createDataFrame([("r",)], "root string")
    assert {(r.url, r.depth) for r in web.crawl(roots, links, 2).collect()} == {("r", 0), ("a", 1), ("b", 2)}


def test_display(spark):
    assert column(spark, ["a  b\nc", "x" * 10 + " y", None], lambda t: P.excerpt(t, 10)) == ["a b c", "x" * 10 + "…", None]
    assert column(spark, ["One. Two.", "no end", " "], P.last_summary) == ["One.", "no end", None]
    told = ["Good answer [d1:c2] . See doc_id 4. Next: - point - end", "doc_id only", "hash deadbeefdeadbeefdead here"]
    assert column(spark, told, P.sanitised) == ["Good answer. Next: point end", "doc_id only", "hash here"]
    assert column(spark, ["w" * 600, "a b"], P.shortened) == ["…", "a b"]


def test_history_and_providers(spark):
    rows = [(1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "user", "q1"), (1, 4, "user", " "), (2, 0, "assistant", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [(r.question, r.place) for r in history.recent_questions(turns).orderBy("place").collect()] == [("q1", 1), ("q2", 2)]
    assert {r.conv_id: r.text for r in history.last_answers(turns).collect()} == {1: "a1", 2: None}
    replies = [("ollama", '{"response": " a "}', "a"), ("llamacpp", '{"content": 3, "text": "b"}', "b"), ("llamacpp", '{"choices":[{"message":{"content":"c"}}]}', "c"), ("groq", '{"choices":[{"delta":{"content":"d"}}]}', "d"), ("groq", '{"message":"e"}', "e"), ("ollama", "{", None), ("ollama", None, None), ("other", '{"response":"x"}', None)]
    made = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(replies)], "i int, p string, b string").orderBy("i")
    assert [r[0] for r in made.select(providers.reply_text(F.col("p"), F.col("b"))).collect()] == [r[2] for r in replies]
    asked = spark.createDataFrame([(1, None), (2, " Groq"), (3, "what")], "i int, provider_override string")
    assert [(r.provider, r.provider_kind) for r in providers.resolved(asked, "ollama").orderBy("i").collect()] == [("ollama", "local"), ("groq", "hosted"), ("stub", "stub")]


def test_server_replies(spark):
    bodies = ['{"data": [{"embedding": [1, 2.5]}, {}]}', '{"embedding": [3]}', '{"x": 1}', "no json", None]
    assert column(spark, bodies, providers.reply_vectors) == [[[1.0, 2.5], []], [[3.0]], None, None, None]
    assert column(spark, ['{"models": [{"name": "a"}, {"name": 3}, "b", {}]}', '{"models": 1}', None], providers.model_names) == [["a"], [], []]
    asked = spark.createDataFrame([("h", "auto"), ("h", "groq"), ("i", None)], "host string, provider_override string")
    tags = spark.createDataFrame([("h", '{"models": [{"name": "Small"}, {"name": "big"}]}'), ("i", "down")], "host string, body string")
    wanted = spark.createDataFrame([(1, "tiny"), (2, "small"), (3, "big")], "priority int, model string")
    got = {(r.host, r.provider_override): (r.provider, r.provider_kind, r.model) for r in providers.chosen(asked, tags, wanted).collect()}
    assert got == {("h", "auto"): ("ollama", "local", "small"), ("h", "groq"): ("groq", "hosted", None), ("i", None): ("stub", "stub", None)}


CUT_OFF = ["R &amp;&amp", "R &amp;&am", "&quo", "&quot;a&ampx; b c&#39 d&#39;e", "&copy &copy;&middot", "R & S &; T", "&notit; &amp;lt;"]


@pytest.mark.parametrize("name", ["page_dedupe_sha1", "page_main_text", "page_title"])
def test_cut_off_references_equal_the_sql(spark, tmp_path, name):
    """Texts that end within a character reference, in titles, headings and paragraphs."""
    rows = [(k, f"https://a.b/{k}", f"<html><head><title>{t}</title></head><body><article><h1>{t}</h1><p><b>{t}</b> end</p></article></body></html>") for k, t in enumerate(CUT_OFF)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    made = duckdb.connect()
    made.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = made.sql(catalogue.ORACLE_SQL[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_references_without_a_semicolon(spark):
    html = "<title>&amp&copy</title><link rel=canonical href='/c?a=1&copy=2'><script>a && b &amp; c</script><p>&ampx; &lt;</p>"
    assert web.read_page(html)[:2] == ("&x; <", "&©") and web.read_page(html, bare=False) == ("&ampx; <", "&amp&copy", "/c?a=1&copy=2", [])
    assert web.read_page("<p>t<script>a && b &amp; &copy</script>", (), bare=False)[0] == "t a && b &amp; &copy"
    assert EngineConfig().bare_references and not EngineConfig.from_env({"RAVELIN_BARE_REFERENCES": "no"}).bare_references
