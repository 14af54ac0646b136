"""Ordered rules over pages, urls, links and institutions: the first that holds gives the reason. All are columns of native expressions.

A ladder is a list of (reason, condition); conditions that are null count as false.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnlake.functions import page_rules as P
from tarnlake.functions import text, urls


def ladder(steps: Iterable[tuple[str, Column]], default: str | None) -> Column:
    """The name of the first step whose condition holds."""
    out = None
    for name, condition in steps:
        holds = F.coalesce(condition, F.lit(False))
        out = F.when(holds, F.lit(name)) if out is None else out.when(holds, F.lit(name))
    return out.otherwise(F.lit(default))


def found(c: Column, pattern: str) -> Column:
    """Whether the pattern occurs in c, in any case."""
    return F.coalesce(c, F.lit("")).rlike("(?i)" + pattern)


def is_word(c: Column, pattern: str) -> Column:
    """Whether c as a whole matches the pattern, in any case."""
    return found(c, f"^(?:{pattern})$")


# Titles and programmes


def non_programme_reason(title: Column, url: Column, strict: bool = False) -> Column:
    """Why a page is no programme, empty if it may be one. strict leaves out the rules on urls, for records whose url is evidence only."""
    t = text.clean_title(title)
    path = F.concat(F.regexp_replace(urls.path(url), "/+$", ""), F.lit("/"))
    steps = [
        ("empty-title", F.length(t) < 4),
        ("category-or-information-page", found(t, P.JUNK_TITLE) | found(t, P.INFO_PAGE_TITLE)),
        ("non-master-degree", found(t, P.NON_MASTER_TITLE)),
    ]
    if not strict:
        steps += [("invalid-source-url", ~urls.is_web(F.coalesce(url, F.lit("")))), ("non-program-path", found(path, P.BLOCKED_PATH) | found(path, P.BLOCKED_PATH_FRAGMENT))]
    return ladder([*steps, ("third-party-source", urls.denied(url))], "")


def is_noise(title: Column, subject: Column, deadlines: Column, materials: Column) -> Column:
    """Titles of lists and other degrees, and programmes of no subject with next to no details."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return found(t, P.LIST_NOISE) | found(t, P.LIST_NOISE_ANY) | F.coalesce((subject == "General") & (deadlines == 0) & (materials < 2), F.lit(False))


def is_junk(title: Column, url: Column, has_detail: Column, materials: Column) -> Column:
    """Titles that no programme has, and very short ones without any detail."""
    t = F.trim(F.coalesce(title, F.lit("")))
    return found(t, P.STORE_JUNK_TITLE) | (non_programme_reason(t, url, strict=True) != "") | ((F.length(t) <= 8) & ~has_detail & (materials == 0))


def keyword_hits(fields: dict[str, Column]) -> Column:
    """array<struct<keyword,priority,location>> of whole-word keywords, in order of priority, keyword and field."""
    hits = []
    for priority, words in (("high", P.HIGH_KEYWORDS), ("adjacent", P.ADJACENT_KEYWORDS)):
        for w in words:
            for name, c in fields.items():
                hits.append(F.when(found(c, rf"\b{w}\b"), F.struct(F.lit(w).alias("keyword"), F.lit(priority).alias("priority"), F.lit(name).alias("location"))))
    return F.array_compact(F.array(*hits))


def is_candidate(hits: Column) -> Column:
    return F.exists(hits, lambda h: h["priority"] == "high")


def discipline_signals(c: Column) -> Column:
    """struct<level, cs, engineering>: strong with terms of both disciplines, moderate with terms of one."""
    of = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(p), F.lit(0))))
    cs, engineering = of(P.CS_TERMS), of(P.ENGINEERING_TERMS)
    both, any_ = (F.size(cs) > 0) & (F.size(engineering) > 0), (F.size(cs) > 0) | (F.size(engineering) > 0)
    return F.struct(ladder([("strong", both), ("moderate", any_)], "unknown").alias("level"), cs.alias("cs"), engineering.alias("engineering"))


# Official urls


def _trusted(host: Column, domains: Column) -> Column:
    return F.exists(domains, lambda d: urls.belongs(host, d))


def crawl_url_steps(url: Column, domains: Column, kind: Column) -> list[tuple[str, Column]]:
    """Why a crawled url is not taken as official coverage; url is in the form of urls.merge_url()."""
    said = urls.signal_text(url)
    graduate, catalog = found(said, P.URL_GRADUATE_LEVEL), found(said, P.URL_CATALOG_SIGNAL)
    admissions = kind.isin("application-deadline", "admission-requirements", "required-documents", "language-requirements")
    return [
        ("invalid-url", ~urls.is_web(url)),
        ("aggregator", found(url, P.URL_AGGREGATOR)),
        ("no-trusted-domain", F.size(domains) <= 0),
        ("off-trusted-domain", ~_trusted(urls.host(url), domains)),
        ("not-specific", ~found(said, P.URL_SPECIFIC)),
        ("wrong-level", found(said, P.URL_WRONG_LEVEL) | found(said, P.URL_DOCTORAL_LEVEL)),
        ("non-master-qualification", found(said, P.URL_NON_MASTER_QUALIFICATION)),
        ("generic-or-noise", found(said, P.URL_NON_PROGRAM_DETAIL)),
        ("not-graduate-level", ~graduate),
        ("generic-or-noise", found(said, P.URL_NOISE) & ~(graduate & catalog)),
        ("announcement", found(said, "(?:call[-_ ]?for|announcement)") & ~catalog),
        ("root-url", (F.regexp_replace(urls.path(url), "^/+|/+$", "") == "") & ~found(urls.host(url), P.URL_SPECIFIC)),
        ("generic-admissions", admissions & ~(graduate | catalog)),
    ]


def crawl_url_reason(url: Column, domains: Column, kind: Column) -> Column:
    return ladder(crawl_url_steps(url, domains, kind), "accepted")


def application_url_reason(url: Column, domains: Column, status: Column, eligible: Column, same_entity: Column) -> Column:
    """The stricter rules for urls that an application audit found; reasons that begin with `accepted` accept."""
    said, path = urls.signal_text(url), urls.path(url)
    master = r"\bmaster(?:s)?\b"
    return ladder([
        ("application-not-captured", ~F.coalesce(status == "captured", F.lit(False))),
        ("application-out-of-scope", ~F.coalesce(eligible, F.lit(False))),
        ("application-canonical-id-mismatch", ~F.coalesce(same_entity, F.lit(False))),
        *crawl_url_steps(url, domains, F.lit("application-audit")),
        ("application-non-program", found(said, P.APPLICATION_NOISE)),
        ("accepted-application-catalog", found(path, P.APPLICATION_CATALOG_ENDPOINT) | (found(path, P.URL_CATALOG_SIGNAL) & found(urls.query(url), master)) | found(path, P.URL_POSTGRADUATE_GUIDE)),
        ("accepted-application-scope-program", found(said, master) & found(said, P.URL_CS_ENGINEERING_URL)),
    ], "application-not-catalog-or-scope-program")


def captured_page(url: Column, domains: Column, status: Column, kind: Column, code: Column, title: Column, body: Column, final_url: Column, hidden: Column, evidence: Column, length: Column, links: Column) -> Column:
    """struct<reason, score> of a captured page as official coverage: 300 or 320 for a catalogue, 220 for a programme in scope.

    hidden: blocked or a shell without content; evidence: whether it may prove a programme at all; links: programme links known.
    """
    t, decoded = F.coalesce(title, F.lit("")), F.coalesce(F.try_url_decode(url), url)
    surface = F.concat_ws(" ", decoded, t, body)
    segments = F.filter(F.split(F.regexp_replace(urls.path(url), "/+$", ""), "/"), lambda s: s != "")
    at_root = F.size(segments) <= 0
    last = F.coalesce(F.try_url_decode(F.try_element_at(segments, F.lit(-1))), F.lit(""))
    before = F.coalesce(F.try_url_decode(F.try_element_at(segments, F.lit(-2))), F.lit(""))
    primary = F.element_at(F.split(t, r"\s+(?:\||::|[-–—])\s+", 2), 1)
    title_noise, last_noise = found(t, P.CAPTURED_PAGE_NOISE), found(F.replace(last, F.lit("-"), F.lit(" ")), P.CAPTURED_PAGE_NOISE)
    title_catalog = found(primary, P.CAPTURED_CATALOG_TITLE)
    listed = r"(?:degree[-_])?(?:programmes?|programs?|degrees?|courses?|overview)(?:\.(?:html?|aspx?))?"
    endpoint = found(last, P.CAPTURED_CATALOG_ENDPOINT) | ((F.size(segments) >= 2) & found(before, "master|graduate|postgraduate") & is_word(last, listed))
    some, level = "(?:programmes?|programs?|degrees?|courses?)", "(?:graduate|postgraduate|master)"
    combined = is_word(last, "programmes?|programs?|degrees?|courses?|(?:programmes?|programs?)[-_]of[-_]study") & found(t, rf"\b{some}\b.{{0,80}}\b{level}\b|\b{level}\b.{{0,80}}\b{some}\b")
    dedicated = at_root & title_catalog
    confirmed = (title_catalog | combined) & ~found(primary, P.CAPTURED_ORGANIZATION_NOISE)
    by_title = confirmed & (endpoint | dedicated | F.lower(kind).isin("category", "catalog") | (links > 0))
    by_endpoint = (endpoint | dedicated) & ~found(t, P.CAPTURED_ORGANIZATION_NOISE) & (links > 0)
    catalog = (by_title | by_endpoint) & ~title_noise & ~last_noise
    master_catalog = catalog & found(primary, r"\b(?:master(?:'?s)?|postgraduate)\b") & found(primary, r"\b(?:programmes?|programs?|degrees?|courses?|catalog(?:ue)?)\b")
    scope = found(surface, P.URL_CS_ENGINEERING_URL)
    host = urls.host(url)
    prefix = F.transform(domains, lambda d: F.when(F.endswith(host, F.concat(F.lit("."), d)), F.left(host, F.length(host) - F.length(d) - 1)))
    central = F.exists(domains, lambda d: d == host) | F.exists(F.array_compact(prefix), lambda p: F.exists(F.split(p, r"\."), lambda label: is_word(label, P.CAPTURED_CENTRAL_SUBDOMAIN)))
    in_scope = found(surface, P.CAPTURED_MASTER_LEVEL) & scope & ~(found(surface, P.CAPTURED_NON_ENGINEERING_SCIENCE) & ~found(surface, r"\bengineering\b"))
    reason = ladder([
        ("captured-not-captured", ~F.coalesce(status == "captured", F.lit(False))),
        ("captured-blocked-or-dynamic", hidden),
        ("captured-discovery-only", ~F.coalesce(evidence, F.lit(True))),
        ("captured-wrong-kind", ~F.coalesce(F.lower(kind).isin("program", "category", "catalog"), F.lit(False))),
        ("captured-http-status", ~code.between(200, 399)),
        ("invalid-url", ~urls.is_web(url)),
        ("no-ror-domain", F.size(domains) <= 0),
        ("off-ror-domain", ~_trusted(host, domains) | ~_trusted(urls.host(F.coalesce(final_url, url)), domains)),
        ("aggregator", found(url, P.URL_AGGREGATOR)),
        ("captured-not-found-page", found(t, r"page not found|\b404\b")),
        ("captured-thin-page", length < 400),
        ("wrong-level", found(decoded, P.URL_DOCTORAL_LEVEL) | found(decoded, P.URL_NON_MASTER_QUALIFICATION)),
        ("generic-or-noise", found(decoded, P.URL_NON_PROGRAM_DETAIL) | found(decoded, P.URL_NOISE) | found(decoded, P.CAPTURED_URL_NOISE)),
        ("wrong-level", found(t, P.CAPTURED_BACHELOR_LEVEL)),
        ("wrong-level", found(surface, P.URL_WRONG_LEVEL) & ~(catalog & ~found(t, P.URL_WRONG_LEVEL))),
        ("non-master-qualification", found(surface, P.URL_NON_MASTER_QUALIFICATION) & ~master_catalog),
        ("root-url", at_root & ~catalog),
        ("captured-non-scope-catalog", catalog & found(surface, P.CAPTURED_NON_SCOPE_CATALOG) & ~scope),
        ("captured-noncentral-catalog", catalog & ~central & ~scope),
        ("accepted-captured-catalog", catalog & found(surface, P.CAPTURED_MASTER_LEVEL)),
        ("captured-non-program-page", title_noise | last_noise),
        ("wrong-level", found(t, P.URL_DOCTORAL_LEVEL)),
        ("accepted-captured-scope-program", in_scope),
    ], "captured-not-catalog-or-scope-program")
    score = F.when(reason == "accepted-captured-catalog", F.when(scope, 320).otherwise(300)).when(reason == "accepted-captured-scope-program", 220).otherwise(0)
    return F.struct(reason.alias("reason"), score.alias("score"))


# What urls count as coverage.
COVERAGE_KINDS = ("master-catalog", "engineering-cs-catalog", "program-page", "admission-requirements", "application-deadline", "required-documents", "language-requirements")
# Plain substrings that give a link's kind, in order; short ones match inside words on purpose.
LINK_KINDS = (
    ("engineering-cs-catalog", ("engineer", "comput", "computer science", "cs ", "electrical", "electronic", "mechanical", "civil", "software", "data science", "machine learning", "artificial intelligence", "ai", "robotics", "information technology", "it ", "cyber", "systems", "industrial", "aerospace", "chemical", "materials", "biomedical", "bioengineering")),
    ("admission-requirements", ("requirement", "eligibility", "prerequisite", "qualification", "entry")),
    ("application-deadline", ("deadline", "apply", "application", "dates", "timeline", "period", "window")),
    ("required-documents", ("document", "transcript", "recommendation", "letter", "statement", "cv", "portfolio", "resume")),
    ("language-requirements", ("language", "english", "ielts", "toefl", "pte", "cambridge", "duolingo", "waec")),
)


def link_kind(c: Column, default: str = "master-catalog") -> Column:
    low = F.lower(c)
    has = lambda words: reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))
    return ladder([(name, has(words)) for name, words in LINK_KINDS], default)


def counts_as_coverage(kind: Column) -> Column:
    return F.coalesce(kind.isin(*COVERAGE_KINDS), F.lit(False))


def url_finding(url: Column) -> Column:
    """Why a url is plainly no programme or catalogue (kind of finding), null if it is not."""
    path = F.coalesce(F.nullif(urls.path(url), F.lit("")), F.lit("/"))
    steps = [("generic-domain-root", (path == "/") & (urls.query(url) == "")), ("non-master-degree-level", found(F.concat(urls.bare_host(url), path), P.NON_MASTER_DEGREE_PATH))]
    return ladder([*steps, *((name, found(path, p)) for name, p in P.NON_PROGRAM_KINDS)], None)


def tracking_finding(url: Column) -> Column:
    return F.when(found(urls.path(url), P.MALFORMED_TRACKING_PATH), "utm-parameters-embedded-in-path")


def shared_url_kind(owners: Column, known: Iterable[frozenset[str]], finding: Column) -> Column:
    """What a url that several entities have means: variants of one institution (owners: their sorted ids, among the known sets) or an unresolved identity."""
    alias = reduce(lambda a, b: a | b, (owners == F.array(*map(F.lit, sorted(k))) for k in known), F.lit(False))
    return ladder([("same-institution-alias-non-program-url", alias & finding.isNotNull()), ("same-institution-alias", alias)], "unclassified-cross-canonical")


def queue_exclusion(verification: Column, discovery: Column, domains: Column, index_url: Column) -> Column:
    """Why an institution is not queued for a look by browser, null if it is."""
    return ladder([
        ("not-verified", ~F.coalesce(verification == "verified", F.lit(False))),
        ("not-no-candidates", ~F.coalesce(discovery == "no-candidates", F.lit(False))),
        ("official-domains-incomplete", F.coalesce(F.size(domains), F.lit(0)) <= 0),
        ("recorded-homepage-missing", F.coalesce(index_url, F.lit("")) == ""),
        ("recorded-homepage-invalid", ~urls.is_web(index_url)),
        ("recorded-homepage-not-official", ~_trusted(urls.host(index_url), domains)),
    ], None)


# Responses and captures


def page_outcome(state: Column, code: Column, error: Column, blocked: Column) -> Column:
    """What a page's record comes to: pending, captured, redirectError, terminalError, blocked or retryableError (failures of no known kind, too)."""
    s, e = F.lower(F.coalesce(state, F.lit(""))), F.coalesce(error, F.lit(""))
    return ladder([
        ("pending", s.isin("pending", "loading", "queued", "not-started")),
        ("captured", s.isin("captured", "complete", "success")),
        ("redirectError", F.contains(s, F.lit("redirect")) | code.between(300, 399) | found(e, "too many redirects|redirect loop|maximum redirects|err_too_many_redirects")),
        ("terminalError", code.isin(404, 405, 410)),
        ("blocked", (s == "blocked") | F.coalesce(blocked, F.lit(False)) | F.coalesce(code.isin(401, 403, 406, 451), F.lit(False)) | found(e, "access denied|captcha|cloudflare|forbidden|robot check|verify you are human")),
    ], "retryableError")


def response_status(ok: Column, code: Column, content_type: Column, visible: Column) -> Column:
    """struct<status, blocked, dynamic_shell> of a response and its visible text."""
    blocked = found(F.left(visible, F.lit(3000)), P.LINK_BLOCKED_TEXT) | F.coalesce(code.isin(401, 403), F.lit(False))
    shell = ok & F.contains(F.lower(content_type), F.lit("html")) & (F.length(visible) < 400)
    return F.struct(F.when(blocked, "blocked").when(ok, "captured").otherwise("error").alias("status"), blocked.alias("blocked"), F.coalesce(shell, F.lit(False)).alias("dynamic_shell"))


def capture_status(category: Column, manifests: Column, candidates: Column, captured: Column) -> Column:
    """How far the capture of an institution has come."""
    review = ("official-review", "official-rejected", "official-discovery-missing", "existing-target-manifest-missing", "verified-target-manifest-missing")
    return ladder([("blocked", category == "official-blocked"), ("needs-review", category.isin(*review)), ("captured", captured > 0), ("checked-no-program", (manifests > 0) | (candidates > 0))], "pending")


def goal_category(existing: Column, new: Column, official: Column, covered: Column) -> Column:
    """Where an institution stands; existing and new: programme candidates of the manifests of that corpus, null without one."""
    return ladder([
        ("existing-program-raw", existing > 0), ("new-program-raw", new > 0), ("verified-zero-candidates", new.isNotNull()), ("existing-zero-candidates", existing.isNotNull()),
        ("verified-target-manifest-missing", official == "verified"), ("official-blocked", official == "blocked"), ("official-rejected", official == "rejected"), ("official-review", official == "review"),
        ("existing-target-manifest-missing", covered),
    ], "official-discovery-missing")


# Statuses and marks of sites that turn visitors away.
BLOCKED_CODES = (401, 403, 406, 409, 423, 429, 451, 503)
WAF_MARKS = ("access denied", "cf-chl-", "cloudflare ray id", "captcha", "verify you are human", "just a moment", "request blocked", "temporarily unavailable", "security check", "web application firewall", "incapsula")


def verification(known: Column, country_match: Column, name_match: Column, has_domains: Column, has_url: Column, domain_match: Column, code: Column, body: Column, final_match: Column, identity: Column, redirected: Column, failed: Column) -> Column:
    """struct<status, reasons> of an institution's website against the registry: verified, review, blocked or rejected, with all reasons in order."""
    low = F.lower(F.coalesce(body, F.lit("")))
    waf = F.coalesce(code.isin(*BLOCKED_CODES), F.lit(False)) | reduce(lambda a, b: a | b, (F.contains(low, F.lit(m)) for m in WAF_MARKS))
    off_domain = has_url & has_domains & ~domain_match
    rejected_early = ~country_match | ~name_match | off_domain
    live = known & ~rejected_early & has_url
    read = live & ~failed
    http_error = read & ~waf & ~code.between(200, 399)
    left = read & ~waf & ~http_error & ~final_match
    mismatch = read & ~waf & ~http_error & ~left & ~identity
    verified = read & ~waf & ~http_error & ~left & ~mismatch & has_domains & domain_match
    codes = [
        ("ror_match_missing", ~known), ("ror_country_mismatch", known & ~country_match), ("ror_name_not_matched", known & ~name_match), ("ror_domains_missing", known & ~has_domains), ("website_url_missing", known & ~has_url),
        ("website_domain_not_in_ror_domains", known & off_domain), ("live_page_fetch_failed", live & failed), ("waf_or_access_block", read & waf), ("live_page_http_error", http_error),
        ("redirected_domain_not_in_ror_domains", left), ("live_page_identity_mismatch", mismatch), ("redirected_within_ror_domain", verified & redirected),
    ]
    status = ladder([("rejected", (known & rejected_early) | left), ("blocked", (live & failed) | (read & waf)), ("verified", verified)], "review")
    return F.struct(status.alias("status"), F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in codes))).alias("reasons"))


def identity_triage(status: Column, reasons: Column, needs_rule: Column, native_title: Column, body_match: Column, acronym: Column, audited_alias: Column, same_family: Column, page_identity: Column, code: Column) -> Column:
    """struct<category, mode>: what is to be done about an institution that was not verified."""
    has = lambda r: F.array_contains(reasons, r)
    mismatch, redirect = has("live_page_identity_mismatch"), has("redirected_domain_not_in_ror_domains")
    auto = ladder([
        ("multilingual-title", mismatch & native_title), ("acronym-or-brand-title", mismatch & body_match), ("acronym-title", mismatch & acronym),
        ("parenthetical-acronym-or-brand", has("ror_name_not_matched") & audited_alias), ("official-domain-redirect", redirect & code.between(200, 399) & (same_family | page_identity)),
    ], None)
    category = ladder([("relationship-rule-required", needs_rule), ("ror-missing", has("ror_match_missing")), ("auto-recoverable", auto.isNotNull()), ("true-rejection", status == "rejected")], "blocked")
    mode = (
        F.when(category == "relationship-rule-required", "configured-non-merging-relationship").when(category == "ror-missing", "saved-ror-candidates-require-review").when(category == "auto-recoverable", auto)
        .when(category == "true-rejection", "selected-ror-identity-conflicts-with-target").when(has("live_page_http_error"), "http-error").otherwise("static-page-identity-inconclusive")
    )
    return F.struct(category.alias("category"), mode.alias("mode"))


# Links


def catalogue_link(label: Column, url: Column, longest: int = 240, least: int = 6) -> Column:
    """struct<score, reason> of a link as one to a catalogue of programmes; label: text, title and aria label joined."""
    fold = lambda c: text.squeeze(F.regexp_replace(F.lower(c), "-", " "))
    path = F.coalesce(F.try_url_decode(urls.path(url)), F.lit(""))
    said, seen = fold(label), fold(F.concat_ws(" ", label, path))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    generic = F.coalesce(F.exists(segments, lambda s: found(fold(F.regexp_replace(s, "[-_]", " ")), P.GENERIC_DIRECTORY_SEGMENT)), F.lit(False))
    points = [F.when(found(seen, p), w).otherwise(0) for _, w, p in (*P.CATALOGUE_SIGNALS, *P.CATALOGUE_NEGATIVE_SIGNALS)]
    score = reduce(lambda a, b: a + b, points) + F.when(generic, 2).otherwise(0)
    named = {n: p for n, _, p in P.CATALOGUE_SIGNALS}
    level = reduce(lambda a, b: a | b, (found(seen, named[n]) for n in ("master-level", "postgraduate-level", "graduate-level")))
    directory = generic | reduce(lambda a, b: a | b, (found(seen, named[n]) & found(said, named[n]) for n in ("catalogue", "programme-list")))
    reason = ladder([
        ("anchor-label-too-long", F.length(label) > longest), ("rejected-path", found(urls.path(url), P.CATALOGUE_REJECT_PATH)), ("missing-degree-level-signal", ~level),
        ("missing-directory-signal", ~directory), ("below-score-threshold", score < least),
    ], "accepted")
    return F.struct(score.alias("score"), reason.alias("reason"))


def page_link(label: Column, url: Column, page_url: Column, prefixes: Column, rel: Column) -> Column:
    """struct<kind, score> of a link on a page: program, category, pagination, or null for one that leads to neither."""
    path, query = urls.path(url), urls.query(url)
    path_text = F.coalesce(F.try_url_decode(F.concat_ws("?", path, query)), url)
    said = F.concat_ws(" ", label, path_text)
    degree, programme = found(said, P.LINK_DEGREE_WORDS), found(said, P.LINK_PROGRAMME_WORDS)
    opaque = found(path, P.LINK_OPAQUE_PROGRAM_PATH)
    detail = opaque | found(path_text, P.LINK_PROGRAM_PATH)
    prefix = F.coalesce(F.exists(prefixes, lambda p: F.startswith(url, p) & (F.length(url) > F.length(p))), F.lit(False))
    category = found(said, P.LINK_CATEGORY_WORDS) | found(path_text, P.LINK_CATEGORY_PATH)
    related = found(said, P.LINK_RELATED_WORDS)
    keys = F.transform(F.split(query, "&"), lambda q: F.element_at(F.split(q, "="), 1))
    pages = found(rel, r"\b(?:next|prev)\b") | F.exists(keys, lambda k: found(k, P.LINK_PAGINATION_QUERY)) | found(label, P.LINK_PAGINATION_TEXT)
    out = (
        found(path, P.LINK_ASSET_PATH) | (url == page_url) | found(said, P.LINK_NON_PROGRAM_SIGNAL) | found(path_text, P.LINK_REJECT_PATH) | (found(said, P.LINK_REJECT_WORDS) & ~degree)
    )
    out_too = (related & ~degree) | (found(said, P.LINK_WRONG_LEVEL) & ~found(label, P.LINK_DEGREE_WORDS))
    kind = (
        F.when(out, None).when(pages, "pagination").when(out_too, None).when(opaque & (F.length(label) >= 5), "program").when(degree & (detail | prefix), "program")
        .when(prefix & ~found(path, P.LINK_GENERIC_CATEGORY), "program").when(category & (degree | programme), "category").when(degree & (urls.depth(url) >= urls.depth(page_url)), "category")
    )
    of = lambda c, w: F.when(c, w).otherwise(0)
    score = F.when(kind == "pagination", 20).otherwise(of(degree, 7) + of(programme, 4) + of(detail, 5) + of(prefix, 5) + of(category, 2) - of(related, 3))
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), score).alias("score"))


# Types of evidence links in order of precedence when told apart, and their order when picked.
EVIDENCE_TYPES = (
    ("deadline", "deadlines?|closing dates?|application dates?"), ("documents", "required documents?|documents? required|application documents?|materials?"),
    ("language", "language|english|ielts|toefl"), ("requirements", "requirements?|eligibility|selection criteria"),
)
EVIDENCE_ORDER = ("deadline", "requirements", "documents", "language", "application")


def evidence_link(said: Column) -> Column:
    """struct<type, score> of a link to application evidence, null for other links."""
    score = F.when(found(said, "deadline|requirements?|eligibility|documents?"), 4).otherwise(0) + F.when(found(said, "apply|application|admission"), 2).otherwise(0)
    kind = ladder([(n, found(said, p)) for n, p in EVIDENCE_TYPES], "application")
    return F.when(found(said, P.LINK_RELATED_WORDS) & ~found(said, P.LINK_WRONG_LEVEL), F.struct(kind.alias("type"), score.alias("score")))


def search_result_score(said: Column, url: Column, tokens: Column, domains: Column) -> Column:
    """How likely a search result is an institution's own page of programmes; -100 for hosts that never are."""
    low = F.lower(F.concat_ws(" ", said, url))
    hits = F.least(F.lit(4), 2 * F.size(F.filter(tokens, lambda t: F.contains(low, t))))
    of = lambda c, w: F.when(c, w).otherwise(0)
    score = of(_trusted(urls.host(url), domains), 10) + hits + of(found(low, "master|msc|graduate|degree.program|study.program"), 4) + of(found(low, "admission|apply|application"), 1)
    score = score + of(found(url, r"programmes?|degree-programs?|study-programmes?|/masters?/"), 5)
    return F.when((urls.host(url) == "") | urls.denied(url), -100).otherwise(score)


# Institutions and programmes

# Regions and countries of the European selection; labels of mainland China.
EUROPE = ("Western Europe", "Northern Europe", "Southern Europe", "Eastern Europe")
OUTSIDE_EUROPE_TARGETS = ("China", "United States", "USA", "United Kingdom", "Australia", "Ireland")
MAINLAND_CHINA = ("china", "china (mainland)", "mainland china", "people's republic of china", "pr china", "prc")
REQUIREMENTS = ("gpa", "ielts", "toefl", "language", "academic")


def is_europe_target(country: Column, region: Column) -> Column:
    return region.isin(*EUROPE) & ~country.isin(*OUTSIDE_EUROPE_TARGETS)


def is_mainland_china(country: Column) -> Column:
    """Hong Kong and Macau are not; used to leave institutions out of queues, never out of rankings."""
    return text.country_key(country).isin(*MAINLAND_CHINA)


def clean_requirements(values: dict[str, Column]) -> Column:
    """A struct of the five requirements, squeezed, null where empty; others are left out."""
    return F.struct(*(F.nullif(text.squeeze(values[k]), F.lit("")).alias(k) if k in values else F.lit(None).cast("string").alias(k) for k in REQUIREMENTS))


def has_requirement(requirements: Column) -> Column:
    return F.coalesce(*(F.nullif(requirements[k], F.lit("")) for k in REQUIREMENTS)).isNotNull()


def requirement_text(requirements: Column) -> Column:
    label = {"ielts": "IELTS ", "toefl": "TOEFL ", "gpa": "GPA "}
    parts = [F.concat(F.lit(label.get(k, "")), F.nullif(requirements[k], F.lit(""))) for k in ("ielts", "toefl", "gpa", "language", "academic")]
    return F.concat_ws(" · ", *parts)


def registry_score(exact: Column, token_exact: Column, sequence: Column, jaccard: Column, same_country: Column, has_domains: Column) -> Column:
    """struct<score, confidence> of an organisation of the registry for an institution."""
    score = F.when(exact, 0.52).when(token_exact, 0.38).otherwise(0.0) + 0.22 * sequence + 0.16 * jaccard + F.when(same_country, 0.08).otherwise(-0.35) + F.when(has_domains, 0.02).otherwise(0.0)
    sure = same_country & (exact | token_exact) & (score >= 0.88)
    return F.struct(F.bround(score, 4).alias("score"), F.when(sure, "high").otherwise("review").alias("confidence"))
