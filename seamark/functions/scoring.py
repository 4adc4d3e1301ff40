"""Severities and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ----

#: What issues of a severity look like, in lower case; the first that matches counts, all others are info.
ERROR = r"^missing (title|h1|canonical|meta description)|^http [45]|served over http|^mixed content|^ai crawlers blocked|^search engines blocked"
WARN = (
    r"too (long|short)|imgs missing alt|imgs with empty alt|images missing alt|thin content|multiple h1|h1 same as title|h1 identical|missing viewport|no schema|"
    r"missing open graph|missing og:image|^slow |^url:|trailing slash|^redirect \(|www normalization|http→https|slow load|heavy html|render-blocking|missing dimensions|"
    r"large dom|base64|many third-party|high ttfb"
)
#: The narrower patterns of the summary cards.
SUMMARY_ERROR = r"^missing (title|h1|canonical|meta description)|^http [45]|served over http|^mixed content"
SUMMARY_WARN = (
    r"too (long|short)|imgs missing alt|imgs with empty alt|thin content|multiple h1|h1 same as title|missing viewport|no schema|missing open graph|missing og:image|"
    r"^slow |^url:|trailing slash|^redirect \(|www normalization|http→https"
)
FATAL = r"search engines blocked|^http [45]"
#: Points an issue costs a page; the first that matches counts, then 10 for an error and 3 for a warning.
PENALTIES = ((r"missing title", 20), (r"missing viewport", 15), (r"missing meta description", 10), (r"missing canonical", 10), (r"imgs missing alt|images missing alt", 10), (r"served over http|^mixed content", 10), (r"thin content", 10))
#: Good and poor limits of the web vitals.
VITALS = {"lcp_ms": (2500, 4000), "inp_ms": (200, 500), "cls": (0.1, 0.25), "fcp_ms": (1800, 3000), "ttfb_ms": (800, 1800)}
#: Limits and points of a page's speed.
SPEED = (
    ("load_time_s", 3.0, 20, "Slow load"), ("ttfb_ms", 800, 15, "High TTFB"), ("html_kb", 150, 10, "Heavy HTML"), ("dom_nodes", 1500, 10, "Large DOM"),
    ("imgs_no_dims", 5, 5, "images missing width/height"), ("base64_images", 3, 5, "base64-inlined images"), ("third_party_scripts", 5, 10, "third-party scripts"),
    ("render_blocking_scripts", 3, 10, "render-blocking scripts"), ("render_blocking_css", 2, 3, "render-blocking stylesheets"),
)


def severity(issue: Column, summary: bool = False) -> Column:
    """error, warn or info."""
    low = F.lower(issue)
    return F.when(low.rlike(SUMMARY_ERROR if summary else ERROR), "error").when(low.rlike(SUMMARY_WARN if summary else WARN), "warn").otherwise("info")


def page_score(issues: Column) -> Column:
    """0 to 100: what the page's issues leave of 100; 0 if one of them is fatal."""

    def points(i):
        low, out = F.lower(i), F.when(F.lit(False), 0)
        for rx, n in PENALTIES:
            out = out.when(low.rlike(rx), n)
        return out.when(low.rlike(ERROR), 10).when(low.rlike(WARN), 3).otherwise(0)

    left = F.aggregate(issues, F.lit(100), lambda acc, i: acc - points(i))
    return F.when(F.exists(issues, lambda i: F.lower(i).rlike(FATAL)), 0).otherwise(F.greatest(F.lit(0), left))


def speed_score(measures: dict[str, Column]) -> Column:
    """0 to 100 from the measures of SPEED; one that is null costs nothing."""
    lost = F.lit(0)
    for name, limit, points, _ in SPEED:
        if name in measures:
            lost = lost + F.when(measures[name] > limit, points).otherwise(0)
    return F.greatest(F.lit(0), F.lit(100) - lost)


def speed_warnings(measures: dict[str, Column]) -> Column:
    """Labels of the limits passed, in fixed order."""
    return F.array_compact(F.array(*(F.when(measures[n] > limit, label) for n, limit, _, label in SPEED if n in measures)))


#: What an issue says of a measure past its limit, before and after the figure.
SPEED_ISSUES = {
    "load_time_s": ("Slow load (", "s — over the 3.0s target)"),
    "ttfb_ms": ("High TTFB (", "ms — Google wants under 800ms for a good LCP)"),
    "html_kb": ("Heavy HTML (", " KB document weight — over the ~150 KB guideline)"),
    "dom_nodes": ("Large DOM (", " nodes — Lighthouse flags over 1500)"),
    "imgs_no_dims": ("", " images missing width/height (layout shift risk)"),
    "base64_images": ("", " base64-inlined images (document bloat)"),
    "third_party_scripts": ("", " third-party scripts (each is a speed + privacy risk)"),
    "render_blocking_scripts": ("", " render-blocking scripts (add async/defer)"),
    "render_blocking_css": ("", " render-blocking stylesheets in head"),
}


def speed_issues(measures: dict[str, Column]) -> Column:
    """Issue texts of the limits passed, with their figures, in fixed order."""
    say = lambda n: F.concat(F.lit(SPEED_ISSUES[n][0]), measures[n].cast("string"), F.lit(SPEED_ISSUES[n][1]))
    return F.array_compact(F.array(*(F.when(measures[n] > limit, say(n)) for n, limit, _, _ in SPEED if n in measures)))


def vital_rating(name: str, value: Column) -> Column:
    good, poor = VITALS[name]
    return F.when(value.isNull(), None).when(value <= good, "good").when(value <= poor, "warn").otherwise("poor")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def half_up(c: Column) -> Column:
    """Rounding to a whole number, halves up."""
    return F.floor(c + 0.5)


# ---- keyword signals ----


def competition(results: Column) -> Column:
    """0 to 100 from the number of results on a log scale; 50 if unknown."""
    return F.when(F.coalesce(results, F.lit(0)) > 0, clamp((F.log10(results) - 3) / 7 * 100, 0.0, 100.0)).otherwise(50.0)


def ad_density(ads: Column) -> Column:
    return F.least(F.lit(100.0), F.coalesce(ads, F.lit(0)) * 25.0)


def volume_proxy(rank: Column, interest: Column, results: Column) -> Column:
    """0 to 100 from suggestion rank, mean interest and result count."""
    by_rank = F.when(F.coalesce(rank, F.lit(0)) == 0, 25.0).otherwise(F.greatest(F.lit(0.0), 100.0 - (rank - 1) * 12.0))
    by_interest = F.least(F.lit(100.0), F.coalesce(interest, F.lit(0.0)) * 1.5)
    by_count = F.least(F.lit(100.0), (F.log10(F.greatest(F.coalesce(results, F.lit(0)), F.lit(1)).cast("double")) - 2) / 6 * 100)
    return F.round(by_rank * 0.45 + by_interest * 0.40 + by_count * 0.15, 1)


def commercial_intent(density: Column, local: Column, snippet: Column, money_words: Column, comp: Column) -> Column:
    money = F.least(F.lit(25.0), money_words * 12.5)
    parts = density * 0.40 + F.when(local, 15.0).otherwise(0.0) + F.when(snippet, 10.0).otherwise(0.0) + money + F.greatest(F.lit(0.0), 100.0 - comp) * 0.10
    return F.least(F.lit(100.0), parts)


def opportunity(trend: Column, comp: Column, intent: Column, volume: Column) -> Column:
    """Rising, easy and commercial keywords first. A competition of 0 counts as unknown."""
    known = F.when(F.coalesce(comp, F.lit(0.0)) == 0, 50.0).otherwise(comp)
    return F.round(F.greatest(F.lit(0.0), F.coalesce(trend, F.lit(0.0))) * 0.30 + (100.0 - known) * 0.40 + F.coalesce(intent, F.lit(0.0)) * 0.20 + F.least(F.lit(100.0), volume) * 0.10, 1)
