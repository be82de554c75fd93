"""Main text of web pages: articles without what their site repeats.

A page becomes a tree. Each page sends the hashes of its element subtrees, navigation,
adverts and footers included; they are counted per host, over pages with different texts. As the
entries of a menu differ from page to page, the shape of a subtree (kinds, attribute names and
classes in it, and its place, without texts) counts as well, where it is mostly links or a little
text that does not run; where the same shape holds running text, that counts against it.
What recurs on ``LEAST_PAGES`` pages is a site's template and deleted from its pages, on those
with an article or main part on ``LEAST_INSIDE``, as a few articles may share a list or table.
These are absolute counts: what stands on so many pages goes on hosts of any size. Texts
outside an article must recur in the same place, and paragraphs and headings of an article
never go that way, so a sentence that many articles share stays; nor does a shape in an article,
unless its name hints at furniture.

Recurrence decides first; kinds and names of elements decide what it can't see, on a host with a
few pages. A name alone takes no part that holds most of the text, except for adverts and
comments. The text is then read from the main part, or the articles, or the page.

What is shuffled is a number per subtree, combined per task. The templates of all hosts go to
every task as long as they are small, and pages stay where they are; else pages meet them as
pairs of host and hash, with hot pairs spread over tasks, so no list of a host is in one place,
and each page gets the list of what goes from it.

Defined cases: a null or empty page, or one with markup only, has an empty text; a page
that ends anywhere is read as far as it goes; a null url is a host of its own; repeated rows
get equal texts; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from songloom.llm.common import stored, text_of
from songloom.llm.markup import candidates, hash_subtrees, main_parts, main_text, parse
from songloom.operators.scratch import with_block
from songloom.operators.skew import join_unique

LEAST_PAGES = 5
LEAST_INSIDE = 10
AGAINST = 10
# Templates of all hosts are broadcast up to so many bytes.
BROADCAST_BYTES = 8 << 20


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(text_of(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _subtrees():
    @F.arrow_udf("struct<body:long,seen:array<long>,against:array<long>,open:array<long>,inside:boolean>")
    def subtrees(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            bodies, lists, within = [], [], []
            for page in pages.to_pylist():
                root = parse(page or "")
                hash_subtrees(root)
                parts = main_parts(root)
                text = main_text(root, parts=parts)
                digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest()
                bodies.append(int.from_bytes(digest, "little", signed=True))
                lists.append(candidates(root))
                within.append(parts[0][1] > 0)
            seen, against, open_ = zip(*lists) if lists else ((), (), ())
            kind = pa.list_(pa.int64())
            columns = [pa.array(bodies, pa.int64()), pa.array(seen, kind), pa.array(against, kind), pa.array(open_, kind), pa.array(within, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, ["body", "seen", "against", "open", "inside"])

    return subtrees.asNondeterministic()


def _cleaned(page: str | None, dropped: frozenset[int] | None) -> str:
    root = parse(page or "")
    if dropped:
        hash_subtrees(root)
    return main_text(root, dropped or frozenset())


def _text():
    @F.arrow_udf("string")
    def text(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for pages, templates in batches:
            out = [_cleaned(page, frozenset(dropped or ())) for page, dropped in zip(pages.to_pylist(), templates.to_pylist())]
            yield pa.array(out, pa.string())

    return text.asNondeterministic()


def _texts_by_host(least: int, inside: int):
    """Texts of pages whose task has the templates of all hosts, in its first row."""
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple[int, int]]] | None = None
        sets: dict[tuple[str, int], frozenset[int]] = {}
        for batch in batches:
            if known is None:
                known = {}
                held = batch["block"].slice(0, 1).flatten()
                for host, hash, pages in zip(*[held.field(c).to_pylist() for c in ("host", "hash", "pages")]) if len(held) else ():
                    known.setdefault(host, []).append((hash, pages))
            out = []
            for page, host in zip(batch["_html"].to_pylist(), batch["host"].to_pylist()):
                if host not in known:
                    out.append(_cleaned(page, None))
                    continue
                root = parse(page)
                hash_subtrees(root)
                needed = inside if main_parts(root)[0][1] else least
                if (host, needed) not in sets:
                    sets[host, needed] = frozenset(hash for hash, pages in known[host] if pages >= needed)
                out.append(main_text(root, sets[host, needed]))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(out, pa.string())], ["page_id", "url", "text"])

    return texts


def page_key(html: str) -> Column:
    return F.unhex(F.md5(text_of(html)))


def subtrees_of(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, page, body, seen, against, open, inside`` per page, stored."""
    found = pages.select(host_of(url).alias("host"), page_key(html).alias("page"), _subtrees()(text_of(html)).alias("x"))
    return stored(found.select("host", "page", "x.*"))


def templates(found: DataFrame, least: int = LEAST_PAGES) -> DataFrame:
    """``host, hash, pages``: subtrees and shapes that recur on a host, and on how many different pages.

    A shape that holds running text on more than one page in ``AGAINST`` is none.
    """
    # Copies of a page are one page here, or they would delete their own article.
    votes = found.select("host", "body", F.explode("seen").alias("hash"), F.lit(1).alias("for")).unionByName(
        found.select("host", "body", F.explode("against").alias("hash"), F.lit(0).alias("for"))
    )
    each = votes.groupBy("host", "body", "hash").agg(F.min("for").alias("for"))
    counted = each.groupBy("host", "hash").agg(F.sum("for").alias("pages"), F.sum(1 - F.col("for")).alias("against"))
    return counted.where((F.col("pages") >= least) & (AGAINST * F.col("against") <= F.col("pages"))).select("host", "hash", "pages")


def lists_of_pages(found: DataFrame, known: DataFrame, least: int = LEAST_PAGES, inside: int = LEAST_INSIDE, **hot) -> DataFrame:
    """``host, page, hashes``: what goes from each different page, if anything; stored. ``known`` are templates."""
    needed = F.when(F.col("inside"), F.lit(inside)).otherwise(F.lit(least)).alias("needed")
    mine = found.select("host", "page", needed, F.explode(F.concat("seen", "open")).alias("hash")).distinct()
    met = join_unique(mine, known, ["host", "hash"], "inner", spread="page", **hot)
    often = met.where(F.col("pages") >= F.col("needed"))
    return stored(often.groupBy("host", "page").agg(F.collect_list("hash").alias("hashes")))


def page_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """One row per page: ``page_id, url, text``."""
    found = subtrees_of(pages, url, html)
    known = stored(templates(found, min(LEAST_PAGES, LEAST_INSIDE)))
    keyed = pages.select(
        F.col(id).alias("page_id"), F.col(url).alias("url"), text_of(html).alias("_html"),
        host_of(url).alias("host"), page_key(html).alias("page"), F.xxhash64(id, url).alias("_spread"),
    )
    # Templates recur, so there are far fewer than pages; their bytes decide.
    if (known.agg(F.sum(F.octet_length("host") + 16)).first()[0] or 0) <= broadcast:
        block = known.agg(F.collect_list(F.struct("host", "hash", "pages")).alias("block"))
        rows = with_block(keyed.select("page_id", "url", "_html", "host"), block)
        types = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("page_id", "url")]
        return rows.mapInArrow(_texts_by_host(LEAST_PAGES, LEAST_INSIDE), ", ".join([*types, "text string"]))
    joined = join_unique(keyed, lists_of_pages(found, known), ["host", "page"], spread="_spread")
    return joined.select("page_id", "url", _text()("_html", "hashes").alias("text"))
