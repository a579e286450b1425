"""URL and HTML functions over native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track.
TRACKING = "utm_[^&]*|fbclid|gclid|ref|source|from|spm|nsukey"
#: Endings of links that aren't pages.
SKIPPED = (
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".svg", ".ico", ".webp",
    ".css", ".js", ".woff", ".woff2", ".ttf", ".eot",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".zip", ".rar", ".7z", ".tar", ".gz",
    ".mp3", ".mp4", ".avi", ".mov", ".wmv", ".flv",
    ".json", ".xml", ".rss", ".atom",
)
#: Elements that hold no content.
NOISE = ("script", "style", "nav", "header", "footer")


def normalize_url(c: Column) -> Column:
    """Without fragment, tracking parameters and a trailing ? or &."""
    plain = F.regexp_replace(c, "#.*$", "")
    return F.regexp_replace(F.regexp_replace(plain, f"([&?])({TRACKING})=[^&]*", ""), "[?&]+$", "")


def host(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def follows(link: Column, base: Column) -> Column:
    """Whether a link leads to a page of the same host."""
    path = F.lower(F.regexp_extract(link, r"^https?://[^/?#]*([^?#]*)", 1))
    return link.rlike("^https?://") & (host(link) == host(base)) & ~path.rlike("(?:" + "|".join(re.escape(e) for e in SKIPPED) + ")$")


def strip_noise(html: Column) -> Column:
    for tag in NOISE:
        html = F.regexp_replace(html, f"(?is)<{tag}[^>]*>.*?</{tag}>", "")
    return html


def title(html: Column) -> Column:
    return unescape(F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " ")))


def links(html: Column) -> Column:
    """href values of anchors, entities decoded; not mail, script or fragment links."""
    found = F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), 1), lambda x: unescape(F.trim(x)))
    return F.filter(found, lambda x: (x != "") & ~x.rlike("(?i)^(mailto:|javascript:|tel:|data:|#)"))


def images(html: Column) -> Column:
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<img\s[^>]*?src\s*=\s*["']([^"']*)["']"""), 1)
    return F.filter(F.transform(found, lambda x: unescape(F.trim(x))), lambda x: (x != "") & ~x.startswith("data:"))


#: The entities of XML and the no-break space.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def visible_text(html: Column) -> Column:
    """Text of a page without noise elements and tags, white space collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(strip_noise(html), "(?s)<[^>]*>", " ")), r"[ \t\r\n]+", " "))


def fold_dots(url: Column) -> Column:
    """A URL whose path has no . and .. segments left; others stay as they are."""
    root = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    tail = F.substring(url, F.length(root) + F.length(path) + 1, F.length(url))
    parts = F.split(path, "/", -1)

    def step(acc: Column, part: Column) -> Column:
        return F.when(part == ".", acc).when(part == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)).otherwise(F.array_append(acc, part))

    folded = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    end = F.when(F.element_at(parts, -1).isin(".", "..") & ~folded.endswith("/"), "/").otherwise("")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), F.concat(root, folded, end, tail)).otherwise(url)


def resolve(link: Column, base: Column) -> Column:
    """A link against its page: absolute, of the scheme, of the host, of the page itself, or of the page's folder; . and .. are folded."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, "[?#].*$", "")
    folder = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(?:/.*)?/)[^/]*$", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
    below = F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), link)
    return (
        F.when(link == "", base).when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), fold_dots(F.concat(root, link)))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link)).when(link.startswith("?"), F.concat(page, link)).otherwise(fold_dots(below))
    )


def select_css(html: Column, selector: str) -> Column:
    """The first element of a #id, .class or tag selector with its first end tag; the whole page if none."""
    if selector.startswith("#"):
        start = rf"""<(\w+)[^>]*\sid\s*=\s*["']{selector[1:]}["'][^>]*>"""
    elif selector.startswith("."):
        start = rf"""<(\w+)[^>]*\sclass\s*=\s*["'][^"']*\b{selector[1:]}\b[^"']*["'][^>]*>"""
    else:
        start = rf"<({selector})(?:\s[^>]*)?>"
    found = F.regexp_extract(html, rf"(?is)({start}.*?</\2>)", 1)
    return F.when(found != "", found).otherwise(html)
