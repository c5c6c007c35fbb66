"""Posting links and page signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlake import fixed_values as V
from postlake.functions.text import contains_any, let, strip


def usable_apply_url(url: Column) -> Column:
    u = F.lower(strip(F.coalesce(url, F.lit(""))))
    return u.startswith("http") & ~contains_any(u, V.UNUSABLE_LINK_PARTS)


def first_usable(*urls: Column) -> Column:
    return F.coalesce(*[F.when(usable_apply_url(u), strip(u)) for u in urls])


def valid_direct_url(portal: Column, url: Column) -> Column:
    """A single posting rather than a search or listing page."""
    raw = strip(F.coalesce(url, F.lit("")))
    low = F.lower(raw)
    pid = F.lower(F.trim(F.coalesce(portal, F.lit(""))))
    own = None
    for name, pattern in V.PORTAL_LINK_PATTERNS.items():
        hit = low.rlike(pattern)
        own = F.when(pid == name, hit) if own is None else own.when(pid == name, hit)
    direct = low.rlike("|".join(V.DIRECT_POSTING_PATTERNS))
    path = F.get(F.split(low, "/", 4), F.lit(3))
    other = ~pid.isin(list(V.PORTAL_LINK_PATTERNS)) & (F.coalesce(F.length(path), F.lit(0)) > 1)
    web = raw.startswith("http://") | raw.startswith("https://")
    return web & ~contains_any(low, V.SEARCH_PAGE_PARTS) & (F.coalesce(own, F.lit(False)) | direct | other)


def direct_url_for_portal(portal: Column, apply_links: Column, related_links: Column) -> Column:
    """First link on the portal's own domain (apply options, then related), else any non-Google apply link."""
    needles = None
    for name, parts in V.PORTAL_LINK_NEEDLES.items():
        arr = F.array(*[F.lit(p) for p in parts])
        needles = F.when(portal == name, arr) if needles is None else needles.when(portal == name, arr)

    def on_portal(link: Column) -> Column:
        low = F.lower(link)
        own = F.exists(needles, lambda n: F.contains(low, n))
        return F.when(needles.isNotNull(), own).otherwise(~low.contains("google.com"))

    def clean(links: Column) -> Column:
        trimmed = F.transform(F.coalesce(links, F.array().cast("array<string>")), strip)
        return F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))

    apply_clean, related_clean = clean(apply_links), clean(related_links)
    return F.coalesce(
        F.get(F.filter(apply_clean, on_portal), F.lit(0)),
        F.get(F.filter(related_clean, on_portal), F.lit(0)),
        F.get(F.filter(apply_clean, lambda x: ~F.lower(x).contains("google.com")), F.lit(0)),
    )


def _refused(status: Column) -> Column:
    return F.when(status.isin(403, 429), F.concat(F.lit("http_"), status.cast("string")))


def detect_block(status: Column, body: Column) -> Column:
    """First block signature found, else the refusing status, else NULL."""

    def signature(head: Column) -> Column:
        return F.coalesce(*[F.when(head.contains(sig), F.lit(sig)) for sig in V.BLOCK_SIGNATURES])

    head = F.lower(F.coalesce(body, F.lit("")))
    return F.coalesce(let(head, signature), _refused(status))


def detect_block_vendor(status: Column, headers: Column, body: Column) -> Column:
    b = F.coalesce(body, F.lit(""))
    denied = contains_any(F.lower(b), V.PROXY_DENY_SIGNATURES)

    def vendor(hay: Column) -> Column:
        return F.coalesce(*[F.when(contains_any(hay, sigs), F.lit(name)) for name, sigs in V.BLOCK_VENDORS])

    hay = F.concat_ws(" ", F.lower(b), F.lower(headers))
    broken = F.when(status >= 500, F.concat(F.lit("server_"), status.cast("string")))
    return F.when(denied, F.lit("LOCAL_PROXY_DENY")).otherwise(F.coalesce(let(hay, vendor), _refused(status), broken))


def visible_words(html: Column) -> Column:
    """Number of words outside scripts and tags."""
    no_script = F.regexp_replace(F.coalesce(html, F.lit("")), "(?is)<script.*?</script>", " ")
    text = F.regexp_replace(no_script, "<[^>]+>", " ")
    words = F.filter(F.split(text, r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")
    return F.size(words)


def is_js_shell(html: Column, items: Column) -> Column:
    return (items == 0) & (visible_words(html) < V.JS_SHELL_WORDS)


def count_job_links(html: Column) -> Column:
    """Distinct job-detail hrefs in the page."""
    found = F.flatten(
        F.array(*[F.regexp_extract_all(html, F.lit("(?i)" + p), F.lit(1)) for p in V.JOB_LINK_PATTERNS])
    )
    return F.size(F.array_distinct(found))
