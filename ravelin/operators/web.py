"""Captured pages: text, links, duplicates and bounded crawls."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urljoin, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.config import EngineConfig
from ravelin.functions import urls as U
from ravelin.operators.ranks import running
from ravelin.scratch import Scratch

#: Name that robots files see.
AGENT = "RavelinBot"

# Elements that are removed before anything is read, and those whose text makes up a page.
REMOVED = ("script", "style", "noscript", "template", "nav", "footer", "form", "aside", "iframe")
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = ("article", "main", "body")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: An ampersand, with the reference that it begins where that has its semicolon.
REFERENCE = re.compile(r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?")
LITERAL = "&#38;"


def only_ended(html: str) -> str:
    """``html`` in which ampersands stand for themselves where no reference with a semicolon begins."""
    return REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else LITERAL + m[0][1:], html)


class _Reader(HTMLParser):
    """Lines of the headings and paragraphs by the container they stand in, the title, the canonical reference and the references of links."""

    def __init__(self, removed: tuple[str, ...], bare: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.removed, self.bare, self.gone = removed, bare, 0
        self.open: list[tuple[str, list[str] | None]] = []
        self.counts: Counter[str] = Counter()
        self.lines: list[tuple[str, list[str]]] = []
        self.live: list[list[str]] = []
        self.seen: set[str] = set()
        self.title: list[str] | None = None
        self.canonical: str | None = None
        self.hrefs: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag == "link" and self.canonical is None and "canonical" in given.get("rel", "").lower():
            self.canonical = given.get("href", "")
        if tag == "a" and given.get("href", "").strip() and not self.gone:
            self.hrefs.append(given["href"].strip())
        if tag in VOID:
            return
        line, name = None, tag
        if tag not in self.removed and not self.gone:
            if tag in HOLDERS and tag not in self.seen:
                self.seen.add(tag)
                name = f"first-{tag}"
            if tag in LINES:
                line = []
                # the best container around it
                self.lines.append((tuple(h for h in HOLDERS if self.counts[f"first-{h}"]), line))
            elif tag == "title" and self.title is None:
                line = self.title = []
        self._enter(name, line)

    def _enter(self, name: str, line: list[str] | None) -> None:
        self.open.append((name, line))
        self.counts[name] += 1
        self.gone += name in self.removed
        if line is not None:
            self.live.append(line)

    def handle_endtag(self, tag):
        names = {tag, f"first-{tag}"}
        if not any(self.counts[n] for n in names):
            return
        while self.open:
            name, line = self.open.pop()
            self.counts[name] -= 1
            self.gone -= name in self.removed
            if line is not None:
                self.live.pop()
            if name in names:
                return

    def handle_data(self, data):
        text = (data.replace(LITERAL, "&") if self.cdata_elem and not self.bare else data).strip()
        if text and not self.gone:
            for line in self.live:
                line.append(text)


def read_page(html: str | None, removed: tuple[str, ...] = REMOVED, bare: bool = True) -> tuple[str, str, str | None, list[str]]:
    """Text of a page (of its first article, else main, else body, else all of it), its title, canonical reference and the references of its links.

    Character references without a semicolon (a text cut off within ``&amp;``)
    are decoded as parsers do, or with ``bare=False`` left as they stand.
    A paragraph that is never ended holds all that follows, so n of them within
    each other have texts of a size that grows with the square of n.
    """
    reader = _Reader(removed, bare)
    reader.feed((html or "") if bare else only_ended(html or ""))
    reader.close()
    holder = next((h for h in HOLDERS if h in reader.seen), None)
    lines = [" ".join(parts) for around, parts in reader.lines if parts and (holder is None or holder in around)]
    return "\n\n".join(lines).strip(), " ".join(reader.title or []).strip(), reader.canonical or None, reader.hrefs


def _joined(base: str | None, reference: str) -> str | None:
    """The reference on its base; null where it is no address."""
    try:
        return urljoin(base or "", reference)
    except ValueError:
        return None


def page_texts(pages: DataFrame, removed: tuple[str, ...] = REMOVED, bare: bool = True) -> DataFrame:
    """page_id, url, canonical_url, title, content and links (distinct normalised links to the page's own origin, sorted) of every page.

    Elements of the names ``removed`` count for nothing, their links included;
    ``bare`` is ``read_page``'s.
    A page without a title has its canonical address as title.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for url, html in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, title, canonical, hrefs = read_page(html, removed, bare)
                base = (_joined(url, canonical) if canonical else None) or url
                out.append((base, title, text, [x for x in dict.fromkeys(_joined(base, h) for h in hrefs) if x]))
            kinds = {"canonical": pa.string(), "title": pa.string(), "content": pa.string(), "links": pa.list_(pa.string())}
            made = [pa.array(column, kind) for column, kind in zip(zip(*out, strict=True) if out else [[]] * 4, kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *made], names=["page_id", "url", *kinds])

    kind = pages.schema["page_id"].dataType.simpleString()
    read = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, canonical string, title string, content string, links array<string>")
    canonical = U.normalised(F.col("canonical"))
    own = F.array_sort(F.array_distinct(F.filter(F.transform("links", U.normalised), lambda x: U.same_origin(F.col("url"), x))))
    return read.select("page_id", "url", canonical.alias("canonical_url"), F.coalesce(F.nullif("title", F.lit("")), canonical).alias("title"), "content", own.alias("links"))


def page_links(pages: DataFrame, removed: tuple[str, ...] = REMOVED) -> DataFrame:
    """page_id and link: distinct normalised links to the page's own origin outside the removed elements."""
    return page_texts(pages, removed).select("page_id", F.explode("links").alias("link")).distinct()


def first_by_content(pages: DataFrame, seq: str = "page_id") -> DataFrame:
    """``pages`` with sha1 of content; of equal contents only the first by ``seq`` stays, blank ones go."""
    hashed = pages.where(F.coalesce("content", F.lit("")) != "").withColumn("sha1", F.sha1("content"))
    first = hashed.groupBy("sha1").agg(F.min(seq).alias("_first"))
    return hashed.join(first, "sha1").where(F.col(seq) == F.col("_first")).drop("_first")


def within_budget(pages: DataFrame, config: EngineConfig = EngineConfig(), by: str = "host", seq: str = "page_id") -> DataFrame:
    """Pages of each site in visit order up to the one that would exceed the characters or the number of pages; those without a site are left out."""
    sized = pages.where(F.col(by).isNotNull()).withColumn("n_chars", F.char_length("content").cast("bigint"))
    run = running(sized, [by], [seq], "n_chars", config.crawl_pages)
    return run.withColumn("visit", F.col("n").cast("int")).withColumnRenamed("total", "total_chars").where(F.col("total_chars") <= config.crawl_chars).drop("n")


def robot_rules(robots: DataFrame) -> DataFrame:
    """host, n, allow and prefix: the rules of each robots file (host, robots and maybe status) for this crawler, in order.

    A file is parsed once.  An answer of 400 and above has no rules; of several
    files of a host the least counts.
    """
    held = robots if "status" not in robots.columns else robots.withColumn("robots", F.when(F.coalesce("status", F.lit(200)) >= 400, "").otherwise(F.col("robots")))
    one = held.where("host IS NOT NULL").groupBy("host").agg(F.min("robots").alias("robots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parser = RobotFileParser()
                parser.parse((text or "").splitlines())
                entry = next((e for e in parser.entries if e.applies_to(AGENT)), parser.default_entry)
                out += [(host, n, bool(rule.allowance), rule.path) for n, rule in enumerate(entry.rulelines if entry else ())]
            kinds = {"host": pa.string(), "n": pa.int32(), "allow": pa.bool_(), "prefix": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds.values(), strict=True)], names=list(kinds))

    return one.mapInArrow(run, "host string, n int, allow boolean, prefix string")


def asked_path(urls: pd.Series) -> pd.Series:
    """What robots rules are held against: path, parameters and query, quoted in one way."""

    def path(url: str | None) -> str | None:
        if url is None:
            return None
        try:
            parts = urlparse(unquote(url))
            return quote(urlunparse(("", "", parts.path, parts.params, parts.query, parts.fragment))) or "/"
        except ValueError:
            return "/"

    return urls.map(path, na_action=None)


def forbidden(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` of addresses that the ``robot_rules`` of their host forbid: of those that the path begins with, the first decides.

    An address meets the rules by equal prefixes, of the lengths that its host's
    rules have; the files themselves travel with no address.
    """
    lengths = rules.groupBy("host").agg(F.collect_set(F.when(F.col("prefix") == "*", 0).otherwise(F.char_length("prefix"))).alias("lengths"))
    given = addresses.select("url").distinct().withColumn("host", U.authority(F.col("url"))).join(lengths, "host")
    paths = given.select("url", "host", F.pandas_udf(asked_path, "string")("url").alias("path"), F.explode("lengths").alias("length")).where(F.col("length") <= F.char_length("path"))
    begins = paths.select("url", "host", F.when(F.col("length") == 0, F.array(F.lit(""), F.lit("*"))).otherwise(F.array(F.expr("substring(path, 1, length)"))).alias("begins"))
    met = begins.select("url", "host", F.explode("begins").alias("prefix")).join(rules, ["host", "prefix"])
    return met.groupBy("url").agg(F.min_by("allow", "n").alias("allow")).where("NOT allow").select("url")


def allowed(pages: DataFrame, robots: DataFrame) -> DataFrame:
    """Pages that the robots file of their host allows; groups by agent, Allow and Disallow, first match."""
    rules = Scratch(pages.sparkSession).table(robot_rules(robots), "rules")
    return pages.join(forbidden(pages, rules), "url", "left_anti").select(*pages.columns)


#: Why an address of a crawl wasn't taken. The first five are reported as skipped.
SKIPPED = ("robots", "missing", "status", "content_type", "origin")


def _settled(level: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """root, place and reason (null: taken) of a level's addresses, of which each taken one rules out later ones.

    ``level`` has root, place, url, reason (known so far), and of the pages that
    can be taken canonical and sha1.  An address goes if it is the canonical one
    of a page taken before it; a page, if its canonical address or its text is
    that of one.  Addresses that no undecided one before them can rule out are
    decided in one pass, and only the others are looked at again.
    """
    open_ = F.col("reason").isNull()
    makes = level.where(open_).select("root", "place", F.explode(F.array(F.concat(F.lit("u"), "canonical"), F.concat(F.lit("t"), "sha1"))).alias("key"))
    own = F.struct(F.lit("seen").alias("why"), F.concat(F.lit("u"), "url").alias("key"))
    other = F.struct(F.lit("canonical").alias("why"), F.concat(F.lit("u"), "canonical").alias("key"))
    text = F.struct(F.lit("text").alias("why"), F.concat(F.lit("t"), "sha1").alias("key"))
    heeds = level.select("root", "place", F.explode(F.when(open_, F.array(own, other, text)).otherwise(F.array(own))).alias("k")).select("root", "place", "k.*")
    left, done, step = level.select("root", "place", "reason"), [], 0
    taken = makes.limit(0).groupBy("root", "key").agg(F.min("place").alias("at"))
    while True:
        here = heeds.join(left.select("root", "place"), ["root", "place"])
        first = makes.join(left.where(open_).select("root", "place"), ["root", "place"]).groupBy("root", "key").agg(F.min("place").alias("maybe"))
        met = here.join(taken, ["root", "key"], "left").join(first, ["root", "key"], "left")
        order = F.when(F.col("why") == "seen", 0).when(F.col("why") == "canonical", 1).otherwise(2)
        judged = met.groupBy("root", "place").agg(F.min(F.when(F.col("at") < F.col("place"), F.struct(order.alias("o"), "why"))).alias("out"), F.max(F.coalesce(F.col("maybe") < F.col("place"), F.lit(False))).alias("waits"))
        judged = scratch.table(left.join(judged, ["root", "place"]), f"{name}-{step}")
        # what has a reason of its own keeps it, unless it was seen before it was asked for
        ready = judged.where("out IS NOT NULL OR NOT waits").select("root", "place", F.when(F.col("out.why") == "seen", "seen").otherwise(F.coalesce("reason", "out.why")).alias("reason"))
        ready = scratch.table(ready, f"{name}-{step}-ready")
        done.append(ready)
        left = judged.where("out IS NULL AND waits").select("root", "place", "reason")
        if not left.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        new = makes.join(ready.where(open_).select("root", "place"), ["root", "place"]).groupBy("root", "key").agg(F.min("place").alias("at"))
        taken = scratch.table(taken.unionByName(new).groupBy("root", "key").agg(F.min("at").alias("at")), f"{name}-{step}-taken")
        step += 1


def crawl_outcomes(roots: DataFrame, pages: DataFrame, robots: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Every address that a crawl from each root comes to, in order, and what became of it.

    root, depth, place, address, reason (null: taken; see ``SKIPPED``, or seen,
    canonical, empty, text, chars), and of pages taken visit, page_id, url
    (canonical), title, content, n_chars.

    ``roots`` has root; ``pages`` page_id, url, html and maybe content_type,
    status and answered (the address that answered in the end); ``robots`` host,
    robots and maybe status.  Pages are visited level by level, by their parent's
    visit and their link.  A crawl ends at the first page that would exceed the
    characters, or with the largest number of pages; what would come after isn't
    reported.  A job for each level; no root is one task's.
    """
    scratch = Scratch(roots.sparkSession)
    asked = roots.where(U.valid_url(F.col("root"))).select("root", U.normalised(F.col("root")).alias("url")).distinct()
    origins = asked.select(U.scheme(F.col("root")).alias("s"), U.authority(F.col("root")).alias("h")).distinct()
    near = pages.join(F.broadcast(origins) if origins.limit(10_001).count() <= 10_000 else origins, (U.scheme(pages["url"]) == F.col("s")) & (U.authority(pages["url"]) == F.col("h")), "left_semi")
    given = lambda name, other: F.coalesce(F.col(name), other) if name in pages.columns else other
    # of captures of one address the first stays; a page is read at the address that answered
    at = near.withColumn("at", U.normalised(F.col("url"))).withColumn("answered", given("answered", F.col("url")))
    at = at.withColumn("kind", F.lower(given("content_type", F.lit("text/html")))).withColumn("status", given("status", F.lit(200)))
    first = at.join(at.groupBy("at").agg(F.min("page_id").alias("page_id")), ["at", "page_id"], "left_semi")
    first = scratch.table(first.select("at", "page_id", "kind", "status", "answered", "html").dropDuplicates(["at"]), "first")
    read = page_texts(first.select(F.col("at").alias("page_id"), F.col("answered").alias("url"), "html"), bare=config.bare_references).drop("url").withColumnRenamed("page_id", "at")
    stored = first.drop("html").join(read, "at").withColumnRenamed("canonical_url", "canonical").withColumn("answered", U.normalised(F.col("answered")))
    stored = scratch.table(stored.withColumn("sha1", F.sha1("content")).withColumn("n_chars", F.char_length("content").cast("bigint")), "stored")
    rules = scratch.table(robot_rules(robots), "rules")
    frontier = scratch.table(asked.withColumn("place", F.lit(1).cast("bigint")), "frontier-0")
    seen, hashes, past, done = frontier.select("root", "url").limit(0), None, None, []
    for depth in range(config.crawl_depth + 1):
        met = frontier.join(stored, frontier["url"] == stored["at"], "left").drop("at")
        closed = forbidden(frontier, rules).select(F.col("url").alias("_closed"))
        met = met.join(closed, F.col("url") == F.col("_closed"), "left")
        places = frontier.select(F.col("root").alias("_root"), F.col("url").alias("_url"), F.col("place").alias("_place"))
        met = met.join(places, (F.col("root") == F.col("_root")) & (F.col("canonical") == F.col("_url")) & (F.col("_place") < F.col("place")), "left").drop("_root", "_url")
        old = seen.select(F.col("root").alias("_root"), F.col("url").alias("_url"))
        met = met.join(old, (F.col("root") == F.col("_root")) & (F.col("canonical") == F.col("_url")), "left").drop("_root")
        if hashes is not None:
            met = met.join(hashes.select(F.col("root").alias("_root"), F.col("sha1").alias("_sha1")).distinct(), (F.col("root") == F.col("_root")) & (F.col("sha1") == F.col("_sha1")), "left").drop("_root")
        else:
            met = met.withColumn("_sha1", F.lit(None).cast("string"))
        html = F.contains("kind", F.lit("text/html"))
        reason = (
            F.when(F.col("_closed").isNotNull(), "robots")
            .when(F.col("page_id").isNull(), "missing")
            .when(F.col("status") != 200, "status")
            .when(~html, "content_type")
            .when(~U.same_origin(F.col("root"), F.col("answered")), "origin")
            .when((F.col("canonical") != F.col("url")) & (F.col("_place").isNotNull() | F.col("_url").isNotNull()), "canonical")
            .when(F.coalesce("content", F.lit("")) == "", "empty")
            .when(F.col("_sha1").isNotNull(), "text")
        )
        level = scratch.table(met.withColumn("reason", reason).drop("_closed", "_place", "_url", "_sha1"), f"level-{depth}")
        settled = _settled(level, scratch, f"settled-{depth}")
        rows = scratch.table(level.drop("reason").join(settled, ["root", "place"]), f"rows-{depth}")
        if past is not None:
            rows = rows.join(past.where("NOT ended").drop("ended"), "root")
        else:
            rows = rows.withColumn("had", F.lit(0).cast("bigint")).withColumn("chars", F.lit(0).cast("bigint"))
        most = max(1, config.crawl_pages)
        good = running(rows.where("reason IS NULL").select("root", "place", "n_chars", "had", "chars"), ["root"], ["place"], "n_chars", most)
        good = good.withColumn("visit", F.col("had") + F.col("n")).where(F.col("visit") <= most).withColumn("over", F.col("chars") + F.col("total") > config.crawl_chars)
        good = scratch.table(good.select("root", "place", "visit", "over", "n_chars"), f"good-{depth}")
        # where the crawl of a root ends: at the first page that is too much, or at the last one that it may have
        ends = good.where(F.col("over") | (F.col("visit") == most)).groupBy("root").agg(F.min("place").alias("last"))
        out = rows.join(good.select("root", "place", "visit", "over"), ["root", "place"], "left").join(ends, "root", "left").where(F.coalesce(F.col("place") <= F.col("last"), F.lit(True)))
        out = out.withColumn("reason", F.when(F.col("over"), "chars").otherwise(F.col("reason"))).withColumn("visit", F.when(~F.col("over"), F.col("visit")))
        out = scratch.table(out.withColumn("depth", F.lit(depth)).drop("had", "chars", "over", "last"), f"out-{depth}")
        done.append(out)
        if depth == config.crawl_depth:
            break
        kept = out.where("reason IS NULL")
        sums = kept.groupBy("root").agg(F.count("*").alias("had"), F.sum("n_chars").alias("chars")).withColumn("ended", F.lit(False))
        stop = ends.select("root", F.lit(0).cast("bigint").alias("had"), F.lit(0).cast("bigint").alias("chars"), F.lit(True).alias("ended"))
        every = sums.unionByName(stop) if past is None else past.unionByName(sums).unionByName(stop)
        past = scratch.table(every.groupBy("root").agg(F.sum("had").alias("had"), F.sum("chars").alias("chars"), F.max("ended").alias("ended")), f"past-{depth}")
        hashes = kept.select("root", "sha1") if hashes is None else hashes.unionByName(kept.select("root", "sha1"))
        seen = scratch.table(seen.unionByName(frontier.select("root", "url")).unionByName(kept.select("root", F.col("canonical").alias("url"))).distinct(), f"seen-{depth}")
        ahead = kept.join(past.where("NOT ended").select("root"), "root", "left_semi").select("root", "visit", F.explode("links").alias("url"))
        ahead = ahead.groupBy("root", "url").agg(F.min("visit").alias("visit")).join(seen, ["root", "url"], "left_anti")
        frontier = scratch.table(running(ahead, ["root"], ["visit", "url"]).select("root", "url", F.col("n").alias("place")), f"frontier-{depth + 1}")
    taken = lambda name: F.when(F.col("reason").isNull(), F.col(name)).alias(name)
    address = F.when(F.col("reason") == "origin", F.col("answered")).otherwise(F.col("url"))
    return reduce(DataFrame.unionByName, done).select("root", "depth", F.col("place").cast("bigint").alias("place"), address.alias("address"), "reason", F.col("visit").cast("int").alias("visit"), taken("page_id"), F.when(F.col("reason").isNull(), F.col("canonical")).alias("url"), taken("title"), taken("content"), taken("n_chars"))


def crawl_pages(roots: DataFrame, pages: DataFrame, robots: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """root, visit, depth, page_id, url (canonical), title, content, n_chars of the captured pages that a crawl from each root takes."""
    return taken_pages(crawl_outcomes(roots, pages, robots, config))


def taken_pages(outcomes: DataFrame) -> DataFrame:
    """The pages of a crawl's outcomes that were taken."""
    return outcomes.where("reason IS NULL").select("root", "visit", "depth", "page_id", "url", "title", "content", "n_chars")


def skipped_addresses(outcomes: DataFrame) -> DataFrame:
    """root, place, depth, address and reason of the addresses that a crawl came to and skipped."""
    return outcomes.where(F.col("reason").isin(*SKIPPED)).select("root", "depth", "place", "address", "reason")


def crawl(roots: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """root, url and depth of all that is reached from the roots over at most ``max_depth`` links, a job for each level."""
    scratch = Scratch(roots.sparkSession)
    frontier = scratch.table(roots.select("root", F.col("root").alias("url"), F.lit(0).alias("depth")).distinct(), "level-0")
    seen = frontier
    for depth in range(1, max_depth + 1):
        ahead = frontier.join(links, F.col("url") == F.col("source")).select("root", F.col("target").alias("url"), F.lit(depth).alias("depth")).distinct()
        frontier = scratch.table(ahead.join(seen.select("root", "url"), ["root", "url"], "left_anti"), f"level-{depth}")
        seen = seen.unionByName(frontier)
    return seen
