"""Clean-up, error detection and phrase checks of texts; the audit of pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import contains_any, slug, strip_tags, substitute, trimmed

#: Names of the output markers that may be left in a text.
MARKERS = "TITLE|SEO|META|KEYWORDS|HTML|END"
#: Labels and forms of phone numbers, in the order in which they are replaced, and the label that replaces them.
LABELS = r"(?:전화|연락처|문의(?:전화)?|상담전화|대표번호|고객센터|Tel\.?|TEL\.?|tel\.?)"
LABELLED_PHONE = LABELS + r"\s*[:：]?\s*(?:\+?82[-\s]?)?(?:0\d{1,2}|01\d)[-\s.]?\d{3,4}[-\s.]?\d{4}"
PHONE = r"(?:\+?82[-\s]?)?0\d{1,2}[-\s.]\d{3,4}[-\s.]\d{4}"
SERVICE_PHONE = r"\b1[5-9]\d{2}[-\s.]?\d{4}\b"
BARE_LABEL = r"(?:전화|연락처|Tel\.?|TEL)\s*[:：]\s*(?=[<\s])"
CONTACT_LABEL = "카카오 상담"
#: Words of a contact link and the host it must have. Where it goes else is a parameter.
CONTACT_WORDS, CONTACT_HOST = "카카오|카톡", r"pf\.kakao\.com"
CONTACT_URL = "https://pf.kakao.com/"
#: Tags that must be closed as often as they are opened.
BALANCED = ("h2", "h3", "table", "ul", "ol", "figure")


def redact_phones(c: Column, label: str = CONTACT_LABEL) -> Column:
    """Labelled numbers become ``label``, others go; labels without a number go too."""
    for pattern, by in ((LABELLED_PHONE, label), (PHONE, ""), (SERVICE_PHONE, ""), (BARE_LABEL, "")):
        c = F.regexp_replace(c, pattern, by)
    return c


def sanitise_links(c: Column, contact_url: str = CONTACT_URL) -> Column:
    """Links whose label, without its tags, has a contact word go to ``contact_url`` if their host is another; links to what is no URL become their label."""
    tag = r"<(?!/a>)(?:(?!</a>)[^>])+>"  # inside the label
    rest = rf"(?:{tag}|[^<]|(?!{tag}|</a>)<)*?"
    words = "|".join(f"(?:{tag})*".join(word) for word in CONTACT_WORDS.split("|"))
    inner = rf"({rest}(?:{words}){rest})"
    c = F.regexp_replace(c, rf"""(?is)<a\b[^>]*?href=(["'])(?![^"']*{CONTACT_HOST})[^"']*\1[^>]*>{inner}</a>""", f'<a href="{contact_url}" target="_blank" rel="noopener">$2</a>')
    return F.regexp_replace(c, r"""(?is)<a\b[^>]*?href=(["'])(?!https?://|/|#|mailto:)[^"']*\1[^>]*>(.*?)</a>""", "$2")


def clean(c: Column) -> Column:
    """Markers, scripts other than JSON-LD, broken characters, empty blocks, phone numbers, links to nowhere and spare white space go."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), rf"(?i)<{{2,3}}\s*(?:{MARKERS})\s*>{{2,3}}", "")
    c = F.regexp_replace(c, r"(?is)<script\b(?![^>]*application/ld\+json)[^>]*>.*?</script>", "")
    c = F.regexp_replace(c, "�+", "")
    for _ in range(3):  # fixed values: the tags and the three passes
        c = F.regexp_replace(c, r"(?i)<(p|h1|h2|h3|h4|li|strong|em|span)>\s*</\1>", "")
    c = sanitise_links(redact_phones(c))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def content_errors(c: Column, least_chars: int = 800) -> Column:
    """Names of what is wrong with a text, sorted: encoding, delimiter, too-short, truncated, broken-html:tag."""
    c = F.coalesce(c, F.lit(""))
    plain = trimmed(F.regexp_replace(c, r"<[^>]+>", ""))
    found = [
        F.when(F.contains(c, F.lit("�")), F.lit("encoding")),
        F.when(c.rlike(rf"(?i)<{{2,3}}\s*(?:{MARKERS})\s*>{{2,3}}"), F.lit("delimiter")),
        F.when(F.length(plain) < least_chars, F.lit("too-short")),
        F.when((c != "") & ~c.rlike(r"(?i)(</[a-z0-9]+>|/>)\s*$"), F.lit("truncated")),
    ]
    found += [F.when(F.regexp_count(c, F.lit(rf"(?i)<{t}\b")) != F.regexp_count(c, F.lit(rf"(?i)</{t}>")), F.lit(f"broken-html:{t}")) for t in BALANCED]
    return F.array_compact(F.array(*found))


def review(df: DataFrame, text: str, forbidden: Sequence[str], fixes: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds cleaned, fixed, errors, phrases (left after fixing) and publishable."""
    out = df.withColumn("cleaned", clean(F.col(text))).withColumn("fixed", substitute(F.col("cleaned"), fixes))
    out = out.withColumn("errors", content_errors(F.col("fixed"))).withColumn("phrases", contains_any(F.col("fixed"), forbidden))
    blocking = F.size(F.filter("errors", lambda e: ~e.startswith("broken-html"))) > 0
    return out.withColumn("publishable", ~blocking & (F.size("phrases") == 0) & ~F.contains(F.coalesce(F.col(text), F.lit("")), F.lit("�")))


def url_ok(url: Column) -> Column:
    """A home page, or a path with a word and no long number or hex run; never a session id."""
    raw = F.coalesce(F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1), F.lit(""))
    path = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), F.lit("/"))  # what cannot be decoded counts as home
    query = F.coalesce(F.regexp_extract(url, r"(\?[^#]*)", 1), F.lit(""))
    session = query.rlike(r"(?i)[?&](sessionid|sid|phpsessid|jsessionid)=")
    home = path.isin("", "/")
    return ~session & (home | (path.rlike(r"(?i)[a-z\x{AC00}-\x{D7A3}]{2,}") & ~path.rlike(r"/\d{6,}(/|$)") & ~path.rlike(r"(?i)[0-9a-f]{16,}")))


def domain(url: Column) -> Column:
    """Host without scheme, ``www.``, port and path, if it looks like a domain of 80 characters at most; else empty."""
    d = F.lower(trimmed(F.coalesce(url, F.lit(""))))
    d = F.regexp_replace(F.regexp_replace(d, "^https?://", ""), r"^www\.", "")
    d = F.regexp_replace(d, r"[/?:].*$", "")
    return F.when(d.rlike(r"^[a-z0-9.-]+\.[a-z]{2,}$") & (F.length(d) <= 80), d).otherwise(F.lit(""))


def disclosed(host: Column, mode: str) -> Column:
    """A host as a mode shows it: ``mask``, ``curated`` (none at all) or whole."""
    return masked(host) if mode == "mask" else F.lit(None).cast("string") if mode == "curated" else host


def masked(host: Column) -> Column:
    """Two characters of the first label and the last label."""
    return F.concat(F.left(F.substring_index(host, ".", 1), F.lit(2)), F.lit("***."), F.element_at(F.split(host, r"\."), -1))


#: Checks of the audit (category, name, points), in their order.
CHECKS = [
    ("content", "title", 10), ("content", "description", 10), ("content", "h1", 6), ("content", "image_alt", 7), ("content", "link_text", 5), ("content", "url_ok", 4),
    ("tech", "https", 6), ("tech", "crawlable", 7), ("tech", "indexable", 6), ("tech", "canonical", 6), ("tech", "viewport", 4), ("tech", "lang", 4),
    ("search", "structured_data", 3), ("search", "open_graph", 3), ("search", "sitemap", 4), ("search", "favicon", 2), ("search", "robots_txt", 3),
    ("speed", "performance", 3), ("speed", "compression", 3), ("speed", "images", 2), ("speed", "rendering", 2),
]
CATEGORIES = list(dict.fromkeys(c for c, _, _ in CHECKS))
#: Link texts that say nothing, without white space.
GENERIC_LINK = r"(?i)^(여기|여기클릭|클릭|클릭하세요|더보기|자세히|자세히보기|바로가기|링크|이동|here|click|clickhere|readmore|more|link|go)$"
#: Agents that must be let in.
AGENTS = ("googlebot", "yeti", "*")
#: Measured audits that overrule a static check, and those that decide a check of speed.
OVERRULES = {"title": "document-title", "description": "meta-description", "image_alt": "image-alt", "link_text": "link-text", "indexable": "is-crawlable", "robots_txt": "robots-txt", "canonical": "canonical", "viewport": "viewport"}
SPEED = {"compression": "uses-text-compression", "images": "uses-webp-images", "rendering": "render-blocking-resources"}


def robots_groups(robots: Column) -> Column:
    """Groups of a robots.txt, each as lines ``U:agent``, ``A`` or ``D`` (root allowed or not) and ``x`` for all other rules."""
    lines = F.transform(F.split(F.coalesce(robots, F.lit("")), r"\r?\n"), lambda x: trimmed(F.regexp_replace(x, "#.*$", "")))
    root = r"^(?i){0}\s*:\s*/(\*|\$)?\s*$"
    agent = r"(?i)^User-agent\s*:\s*(.+)$"
    kind = lambda x: F.when(x.rlike(agent), F.concat(F.lit("U:"), F.lower(trimmed(F.regexp_extract(x, agent, 1))))).when(x.rlike(root.format("Allow")), "A").when(x.rlike(root.format("Disallow")), "D").otherwise("x")
    kinds = F.transform(F.filter(lines, lambda x: x != ""), kind)
    agents = lambda i: F.coalesce(F.get(kinds, i).startswith("U:"), F.lit(False))
    opened = F.transform(kinds, lambda x, i: F.when(agents(i) & ~agents(i - 1), F.concat(F.lit("\f"), x)).otherwise(x))
    return F.transform(F.slice(F.split(F.array_join(opened, "\n"), "\f"), 2, 1 << 30), lambda g: F.concat(F.lit("\n"), g, F.lit("\n")))


def robots_allows(robots: Column, agent: str) -> Column:
    """Whether a robots.txt lets an agent read the root: by the first group that names it, else the first for all; allowing wins."""
    groups = robots_groups(robots)
    named = lambda name: F.get(F.filter(groups, lambda g: F.contains(g, F.lit(f"\nU:{name}\n"))), F.lit(0))
    group = F.coalesce(named(agent.lower()), named("*"), F.lit(""))
    return ~(F.contains(group, F.lit("\nD\n")) & ~F.contains(group, F.lit("\nA\n")))


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag; empty without one."""
    found = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(found, """^["']|["']$""", "")


#: Elements that scripts fill, when they are empty.
EMPTY_ROOT = r"""(?is)<[a-z][a-z0-9-]*(?:\s[^>]*)?\s(?:id\s*=\s*(?:"(?:root|app)"|'(?:root|app)'|root|app)|data-reactroot(?:=[^\s>]*)?)(?:\s[^>]*)?>(?:<!--.*?-->)*</"""
#: Up to the opening of the body; without one, up to the end of the head.
BEFORE_BODY = r"(?is)^.*?<body\b[^>]*>"
BEFORE_END_OF_HEAD = r"(?is)^.*?</head\s*>"


def body_of(html: Column) -> Column:
    """What stands in the body of a page."""
    return F.when(html.rlike(r"(?i)<body\b"), F.regexp_replace(html, BEFORE_BODY, "")).otherwise(F.regexp_replace(html, BEFORE_END_OF_HEAD, ""))


def page_checks(pages: DataFrame, url: str = "url", html: str = "html", robots: str | None = None) -> DataFrame:
    """Adds one nullable boolean a check; null is pending. Speed is pending until it is measured.

    Counted with patterns over the raw page, so the whole audit stays one projection. ``robots`` is the column with
    the robots.txt of the host; without one it counts as empty.
    """
    h = F.coalesce(F.col(html), F.lit(""))
    rules = F.coalesce(F.col(robots), F.lit("")) if robots else F.lit("")
    n = lambda pattern: F.regexp_count(h, F.lit(pattern))
    every = lambda pattern, group=0: F.regexp_extract_all(h, F.lit(pattern), F.lit(group))
    metas = every(r"(?i)<meta\s[^>]*>")
    named = lambda kind, name: F.filter(metas, lambda m: F.lower(trimmed(_attribute(m, kind))) == name)
    content = lambda kind, name: trimmed(F.coalesce(_attribute(F.get(named(kind, name), F.lit(0)), "content"), F.lit("")))
    inside = body_of(h)
    title, titles = trimmed(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1)), n(r"(?i)<title\b") - F.regexp_count(F.when(h.rlike(r"(?i)<body\b|</head\s*>"), inside).otherwise(""), F.lit(r"(?i)<title\b"))
    size = lambda tag, name: F.regexp_extract(_attribute(tag, name), r"^\s*(\d+)", 1).try_cast("int")
    pixel = lambda t: F.coalesce((size(t, "width") == 1) & (size(t, "height") == 1), F.lit(False)) | F.coalesce(size(t, "width") == 0, F.lit(False)) | F.coalesce(size(t, "height") == 0, F.lit(False))
    images = F.filter(every(r"(?i)<img\s[^>]*>"), lambda t: t.rlike(r"""(?i)\s(src|data-src|srcset)\s*=\s*["']?[^"'>\s]""") & ~pixel(t))
    without_alt = F.size(F.filter(images, lambda t: ~t.rlike(r"(?i)\salt(\s|=|/|>)")))
    link = r"(?is)<a(\s[^>]*)>(.*?)</a>"
    links = F.filter(F.arrays_zip(every(link, 1).alias("tag"), every(link, 2).alias("inner")), lambda a: ~trimmed(_attribute(a["tag"], "href")).rlike(r"(?i)^($|#|javascript:|mailto:|tel:)"))
    said = lambda a: F.regexp_replace(F.regexp_replace(a["inner"], "<[^>]*>", ""), r"\s+", "")
    bad = F.size(F.filter(links, lambda a: ~a["inner"].rlike(r"(?i)<img\b") & ((said(a) == "") | said(a).rlike(GENERIC_LINK) | said(a).rlike("(?i)^https?://"))))
    scripts, ld = n(r"(?i)<script\s[^>]*src"), h.rlike(r"(?i)application/ld\+json")
    og = (content("property", "og:title") != "") & (content("property", "og:description") != "")
    body = F.length(trimmed(F.regexp_replace(F.regexp_replace(inside, r"(?s)<!--.*?-->|<[^>]*>", ""), r"\s+", " ")))
    h1s = n(r"(?i)<h1\b")
    suspect = ((body < 150) & (scripts >= 2) & (title == "") & (h1s == 0)) | h.rlike(EMPTY_ROOT) | ((scripts >= 4) & ~ld & ~og) | ((titles == 0) & (body < 400))
    js = lambda ok: F.when(ok, True).when(suspect, F.lit(None).cast("boolean")).otherwise(False)
    robots_meta = F.concat(content("name", "robots"), F.when(content("name", "robots") == "", content("name", "googlebot")).otherwise(""))
    pending = F.lit(None).cast("boolean")
    return pages.withColumns(
        {
            "title": js((title != "") & (titles <= 1) & F.length(title).between(10, 60)),
            "description": js((content("name", "description") != "") & (F.size(named("name", "description")) <= 1)),
            "h1": js(h1s == 1),
            "image_alt": without_alt * 10 <= F.size(images),
            "link_text": bad * 5 <= F.size(links),
            "url_ok": url_ok(F.col(url)),
            "https": F.lower(F.coalesce(F.col(url), F.lit(""))).startswith("https:"),
            "crawlable": robots_allows(rules, AGENTS[0]) & robots_allows(rules, AGENTS[1]) & robots_allows(rules, AGENTS[2]),
            "indexable": ~robots_meta.rlike("(?i)noindex"),
            "canonical": F.exists(every(r"(?i)<link\s[^>]*>"), lambda t: (F.lower(_attribute(t, "rel")) == "canonical") & (_attribute(t, "href") != "")),
            "viewport": content("name", "viewport") != "",
            "lang": trimmed(_attribute(F.regexp_extract(h, r"(?i)<html\s[^>]*>", 0), "lang")) != "",
            "structured_data": js(ld),
            "open_graph": js(og),
            "sitemap": rules.rlike(r"(?im)^\s*sitemap\s*:"),
            "favicon": F.exists(every(r"(?i)<link\s[^>]*>"), lambda t: F.lower(_attribute(t, "rel")).rlike(r"(^|\s)icon(\s|$)|^apple-touch-icon$")),
            "robots_txt": trimmed(rules) != "",
            **{name: pending for category, name, _ in CHECKS if category == "speed"},
        }
    )


def measured_checks(checked: DataFrame, measured: DataFrame, page: str) -> DataFrame:
    """Measured pages (``page``, performance from 0 to 1, audits: map of scores) overrule their static checks and get those of speed; adds ``measured``.

    A score of 1 passes and 0 fails; any other leaves the static check. Speed passes at 90 of 100, and where its audit has 1 or no score.
    """
    rows = checked.join(measured.select(page, F.col("performance").alias("__perf"), F.col("audits").alias("__audits")), page, "left")
    score = lambda name: F.try_element_at("__audits", F.lit(name))
    there = F.col("__audits").isNotNull()
    new = {name: F.when(score(audit) == 1, True).when(score(audit) == 0, False).otherwise(F.col(name)) for name, audit in OVERRULES.items()}
    new["performance"] = F.when(there, F.floor(F.coalesce("__perf", F.lit(0.0)) * 100 + 0.5) >= 90)
    for name, audit in SPEED.items():
        new[name] = F.when(there, F.map_contains_key("__audits", F.lit(audit)) & (F.coalesce(score(audit), F.lit(1.0)) == 1))
    return rows.withColumns({"measured": there, **new}).drop("__perf", "__audits")


def _sums(category: str) -> dict[str, Column]:
    """Sums over the checks of a category of one row."""
    own = [(F.col(name), points) for c, name, points in CHECKS if c == category]
    add = lambda value: sum((value(ok, points) for ok, points in own), F.lit(0)).cast("bigint")
    count = lambda ok, when: F.coalesce(when(ok).cast("int"), F.lit(0))
    out = {"score": add(lambda ok, p: count(ok, lambda x: x) * p), "max": F.lit(sum(p for _, p in own)).cast("bigint"), "pending": F.coalesce(*[F.when(ok.isNull(), True) for ok, _ in own], F.lit(False))}
    out |= {"passed": add(lambda ok, p: count(ok, lambda x: x)), "failed": add(lambda ok, p: count(ok, lambda x: ~x)), "open": add(lambda ok, p: ok.isNull().cast("int")), "improvable": add(lambda ok, p: count(ok, lambda x: ~x) * p)}
    return out | {"pct": F.when(out["pending"], F.lit(0)).otherwise(F.floor(out["score"] * 100.0 / out["max"] + 0.5)).cast("bigint")}


def audit(checked: DataFrame, page: str) -> DataFrame:
    """A row for each page and category: score, max, pending, counts and pct (0 while pending). Nothing is shuffled."""
    rows = F.array(*[F.struct(F.lit(c).alias("category"), *[v.alias(k) for k, v in _sums(c).items()]) for c in CATEGORIES])
    return checked.select(page, F.inline(rows))


def audit_totals(checked: DataFrame, page: str) -> DataFrame:
    """A row for each page: total and max over the categories that are complete, speed aside (over all of them once measured), and counts over all checks."""
    sums = {c: _sums(c) for c in CATEGORIES}
    measured = F.col("measured") if "measured" in checked.columns else F.lit(False)
    headline = lambda k: sum((F.when(~s["pending"] | measured, s[k]).otherwise(F.lit(0).cast("bigint")) for c, s in sums.items() if c != "speed"), F.lit(0)).cast("bigint")
    every = lambda k: sum((s[k] for s in sums.values()), F.lit(0)).cast("bigint")
    out = checked.select(page, headline("score").alias("total"), headline("max").alias("max"), *[every(k).alias(k) for k in ("passed", "failed", "open", "improvable")])
    return out.withColumn("pass_rate", F.floor(F.coalesce(F.try_divide(F.col("passed") * 100.0, (F.col("passed") + F.col("failed")).cast("double")), F.lit(0.0)) + 0.5).cast("bigint"))


def headings(html: Column) -> Column:
    """Levels, texts and ids of h2 to h4 in page order; a heading without an id gets the slug of its text."""
    h = F.coalesce(html, F.lit(""))
    pattern = F.lit(r"(?is)<h([2-4])\b([^>]*)>(.*?)</h\1>")
    parts = F.arrays_zip(*[F.regexp_extract_all(h, pattern, F.lit(i)).alias(n) for i, n in enumerate(("level", "tag", "text"), 1)])
    plain = lambda x: trimmed(F.regexp_replace(x["text"], r"<[^>]+>", ""))
    own = lambda x: F.coalesce(F.nullif(_attribute(x["tag"], "id"), F.lit("")), slug(plain(x)))
    return F.transform(parts, lambda x: F.struct(x["level"].cast("int").alias("level"), plain(x).alias("text"), own(x).alias("id")))


#: Headings that open questions and answers.
FAQ_HEADING = r"(?i)자주\s*묻는\s*질문|FAQ|자주하는\s*질문"


def faq_pairs(html: Column, most: int = 10) -> Column:
    """Questions and answers (q, a) behind the first FAQ heading up to the next h2; null if there are fewer than two.

    Labels and numbers before a question go, a question mark is added; questions of four characters and answers of ten count.
    """
    h = F.coalesce(html, F.lit(""))
    parts = F.lit(r"(?is)<h2\b[^>]*>((?:(?!</h2>).)*)</h2>((?:(?!<h2\b).)*)")
    heads = F.arrays_zip(F.regexp_extract_all(h, parts, F.lit(1)).alias("head"), F.regexp_extract_all(h, parts, F.lit(2)).alias("body"))
    body = F.coalesce(F.get(F.filter(heads, lambda x: strip_tags(x["head"]).rlike(FAQ_HEADING)), F.lit(0))["body"], F.lit(""))
    pair = F.lit(r"(?is)<h[34]\b[^>]*>(.*?)</h[34]>\s*(?:<p\b[^>]*>(.*?)</p>)?")
    found = F.arrays_zip(F.regexp_extract_all(body, pair, F.lit(1)).alias("q"), F.regexp_extract_all(body, pair, F.lit(2)).alias("a"))
    question = lambda x: trimmed(F.regexp_replace(strip_tags(x["q"]), r"(?i)^\s*(?:Q[.):]\s*)?(?:\d{1,2}[.):]\s*)?", ""))
    plain = F.transform(found, lambda x: F.struct(question(x).alias("q"), trimmed(F.regexp_replace(strip_tags(x["a"]), r"^\s*A[.):]\s+", "")).alias("a")))
    good = F.filter(plain, lambda x: (F.length(x["q"]) >= 4) & (F.length(x["a"]) >= 10))
    asked = F.transform(good, lambda x: F.struct(F.when(x["q"].rlike("[?？]$"), x["q"]).otherwise(F.concat(x["q"], F.lit("?"))).alias("q"), x["a"].alias("a")))
    return F.when(F.size(asked) >= 2, F.slice(asked, 1, most))


def faq(html: Column, most: int = 10) -> Column:
    """The pairs as a FAQPage object of schema.org in JSON; null without."""
    pairs = faq_pairs(html, most)
    entity = lambda x: F.struct(F.lit("Question").alias("@type"), x["q"].alias("name"), F.struct(F.lit("Answer").alias("@type"), x["a"].alias("text")).alias("acceptedAnswer"))
    return F.when(pairs.isNotNull(), F.to_json(F.struct(F.lit("https://schema.org").alias("@context"), F.lit("FAQPage").alias("@type"), F.transform(pairs, entity).alias("mainEntity"))))


def is_blocked_host(host: Column) -> Column:
    """Names and addresses of private networks, which a crawl must not reach."""
    h = F.lower(F.coalesce(host, F.lit("")))
    named = h.isin("localhost", "0.0.0.0", "::1") | h.endswith(".local") | h.endswith(".internal")
    octet = lambda i: F.get(F.split(h, r"\."), F.lit(i)).try_cast("int")
    a, b = octet(0), octet(1)
    private = a.isin(10, 127, 0) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    return named | (h.rlike(r"^(\d{1,3}\.){3}\d{1,3}$") & F.coalesce(private, F.lit(False)))
