"""Web pages: extraction, quality, links, outcomes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements and roles that are no content, elements without an end, marks of a blocked page.
CHROME = {"nav", "script", "style", "footer", "aside", "noscript", "form"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKED = ("captcha", "access denied", "verify you are human", "cf-challenge")


class _Markdown(HTMLParser):
    """A page's main region as Markdown: headings, paragraphs, lists, tables, links, images, code. Chrome is skipped by element, ARIA role and aria-hidden."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.base, self.base_seen, self.out, self.links, self.title, self.in_title = url, False, [], [], "", False
        self.marks: dict[str, int] = {}
        self.skipped: list[str] = []  # the element being skipped, once for each nesting of its own name
        self.lists: list[list] = []  # kind and number of each open list
        self.href: str | None = None
        self.pre = False
        self.cells: list[str] | None = None
        self.cell_from = self.rows = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.append(tag)
            return
        if tag in CHROME or a.get("role") in ROLES or a.get("aria-hidden") == "true":
            if tag not in VOID:  # a void element has no end to wait for
                self.skipped.append(tag)
        elif tag == "base":
            if a.get("href") and not self.base_seen:
                self.base, self.base_seen = urljoin(self.base, a["href"]), True
        elif tag == "title":
            self.in_title = True
        elif tag in ("main", "article") or a.get("role") == "main":
            self.marks.setdefault("main" if a.get("role") == "main" else tag, len(self.out))
        elif tag[0] == "h" and tag[1:].isdigit():
            self.out.append("\n\n" + "#" * int(tag[1:]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.out.append("\n" if len(self.lists) == 1 else "")
        elif tag == "li":
            top = self.lists[-1] if self.lists else ["ul", 0]
            top[1] += 1
            self.out.append("\n" + "  " * max(0, len(self.lists) - 1) + (f"{top[1]}. " if top[0] == "ol" else "- "))
        elif tag in ("p", "div", "section", "blockquote") and self.cells is None:
            self.out.append("\n\n" + ("> " if tag == "blockquote" else ""))
        elif tag == "br":
            self.out.append(" " if self.cells is not None else "\n")
        elif tag == "hr":
            self.out.append("\n\n---\n\n")
        elif tag == "pre":
            self.pre = True
            self.out.append("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag == "img" and a.get("alt"):
            self.out.append(f"![{a['alt']}]({urljoin(self.base, a.get('src', ''))}) ")
        elif tag == "a" and a.get("href") and not a["href"].startswith("#"):
            self.href = urljoin(self.base, a["href"])
            self.links.append(self.href)
            self.out.append("[")
        elif tag == "table":
            self.rows = 0
            self.out.append("\n")
        elif tag == "tr":
            self.cells = []
        elif tag in ("td", "th") and self.cells is not None:
            self.cell_from = len(self.out)

    def handle_endtag(self, tag: str) -> None:
        if self.skipped:
            if tag == self.skipped[-1]:
                self.skipped.pop()
        elif tag == "title":
            self.in_title = False
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        elif tag == "pre" and self.pre:
            self.pre = False
            self.out.append("\n```\n")
        elif tag == "code" and not self.pre:
            if self.out:
                self.out[-1] = self.out[-1].rstrip(" ")
            self.out.append("` ")
        elif tag == "a" and self.href:
            if self.out:
                self.out[-1] = self.out[-1].rstrip(" ")
            self.out.append(f"]({self.href}) ")
            self.href = None
        elif tag in ("td", "th") and self.cells is not None:
            self.cells.append("".join(self.out[self.cell_from :]).strip().replace("|", "\\|"))
            del self.out[self.cell_from :]
        elif tag == "tr" and self.cells is not None:
            if self.cells:
                self.out.append("\n| " + " | ".join(self.cells) + " |" + ("\n|" + "---|" * len(self.cells) if not self.rows else ""))
                self.rows += 1
            self.cells = None

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.in_title:
            self.title += data
        elif self.pre:
            self.out.append(data)
        elif data.strip():
            self.out.append(" ".join(data.split()) + " ")

    def result(self) -> tuple[str, str]:
        region = "main" if "main" in self.marks else "article" if "article" in self.marks else "body"
        text = "".join(self.out[self.marks.get(region, 0) :])
        return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.strip().split("\n"))), region


def extract_pages(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """key, title, markdown, region, links, warnings of each page; one pass over partitions, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, u, h in zip(pdf["k"], pdf["u"], pdf["h"], strict=True):
                p = _Markdown(u or "")
                p.feed(h or "")
                text, region = p.result()
                warnings = [w for w, on in (("no_content", not text), ("no_main_region", region == "body")) if on]
                rows.append((k, " ".join(p.title.split()), text, region, p.links, warnings))
            yield pd.DataFrame(rows, columns=["k", "title", "markdown", "region", "links", "warnings"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), F.col(html).alias("h")).mapInPandas(run, f"k {kind}, title string, markdown string, region string, links array<string>, warnings array<string>")
    return out.withColumnRenamed("k", key)


def visible_text(html: Column) -> Column:
    """Text without scripts, styles and tags, white space single."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(?:script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def page_quality(html: Column) -> Column:
    """BLOCKED by a marker; EMPTY_SHELL for under 150 characters with over 3 scripts or an application root; PARTIAL under 80; else HIGH."""
    low, n = F.lower(html), F.length(visible_text(html))
    blocked = F.lit(False)
    for m in BLOCKED:
        blocked = blocked | low.contains(m)
    shell = (n < 150) & ((F.regexp_count(low, F.lit("<script")) > 3) | low.contains('id="root"') | low.contains('id="app"') | low.contains("enable javascript"))
    return F.when(blocked, "BLOCKED").when(shell, "EMPTY_SHELL").when(n < 80, "PARTIAL").otherwise("HIGH")


def page_links(html: Column, base: Column, most: int = 50) -> Column:
    """Absolute links in order, fragment-only ones dropped, the first `most` (the feature's limit)."""
    hrefs = F.filter(F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1)), lambda h: (h != "") & ~h.startswith("#"))
    root = F.regexp_extract(base, r"^(https?://[^/]+)", 1)
    folder = F.regexp_extract(base, r"^(https?://[^/]+(?:/[^/?#]*)*/)", 1)
    absolute = F.transform(hrefs, lambda h: F.when(h.rlike(r"^[a-z][a-z0-9+.-]*:"), h).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), h)))
    return F.slice(absolute, 1, most)


def status_outcome(status: Column) -> Column:
    return F.when(status == 429, "rate_limited").when(status >= 400, "http_error").otherwise("ok")


def domain_strategy(outcomes: DataFrame) -> DataFrame:
    """State of each domain: last good tier, successes, requires_js, delay (0.5 doubled by each 429, at most 10). outcomes: domain, ts, tier, outcome."""
    good = F.col("outcome") == "ok"
    n429 = F.count_if(F.col("outcome") == "rate_limited")
    return outcomes.groupBy("domain").agg(
        F.max_by(F.when(good, F.col("tier")), F.when(good, F.struct("ts", "tier"))).alias("tier"),
        F.count_if(good).alias("successes"),
        F.coalesce(F.bool_or((F.col("outcome") == "shell") | (good & (F.col("tier") == "headless"))), F.lit(False)).alias("requires_js"),
        F.least(0.5 * F.pow(F.lit(2.0), n429), F.lit(10.0)).alias("delay"),
    )


def broken_links(links: DataFrame, anchors: DataFrame) -> DataFrame:
    """Links (page, target, anchor) whose target and anchor are not among the anchors (target, anchor)."""
    return links.join(anchors.distinct(), ["target", "anchor"], "left_anti")


def decode_body(body: Column, content_type: Column) -> Column:
    """Text of bytes: byte-order mark, then the declared charset, then a <meta charset> in the first 1024 bytes, then UTF-8, invalid bytes replaced."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series, kind: pd.Series) -> pd.Series:
        import codecs
        import re

        def one(b: bytes | None, k: str | None) -> str | None:
            if b is None:
                return None
            for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
                if b.startswith(mark):
                    return b.decode(name, "replace")
            named = re.search(r"charset=[\"']?([\w-]+)", k or "") or re.search(r"<meta[^>]*charset=[\"']?([\w-]+)", b[:1024].decode("ascii", "ignore"))
            try:
                return b.decode(named[1] if named else "utf-8", "replace")
            except LookupError:
                return b.decode("utf-8", "replace")

        return pd.Series([one(b, k) for b, k in zip(raw, kind, strict=True)], dtype=object)

    return decode(body, content_type)
