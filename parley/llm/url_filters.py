"""URL filter: pattern rules indexed by their rarest literal token.

Token counts over all URLs pick, for each rule, the rarest of the literal
tokens that every matching URL must hold.  The tokens of a URL fetch the rules
indexed under them, and only those run their regular expressions, on the
lower-cased host followed by the path.  Rules have a rank: of the fitting
rules with the best rank the longest wins, then the first.

Verdicts depend on the URL alone, so each distinct URL is judged once and its
verdict joined back; hot URLs are spread over many partitions.  The index is
broadcast only while it has at most BROADCAST_RULES rows, else it is joined by
token with the hot tokens spread.

Built-in expressions and joins only, no Python.

Defined results.  A null URL or one without ``://`` has an empty host and
path, fits no rule and is allowed.  Repeated rows get equal verdicts.  An
empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, skew_join

BROADCAST_RULES = 100_000
#: Runs of letters or of digits: a number that may follow a literal doesn't change its token.
TOKEN = "[a-z]+|[0-9]+"


@dataclass(frozen=True)
class Rule:
    """``tokens``: runs of lower-cased ASCII letters or of digits that every match of ``pattern`` holds."""

    name: str
    verdict: str
    rank: int
    pattern: str
    tokens: tuple[str, ...]


def host_rule(verdict: str, host: str, path: str, rank: int = 0) -> Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path`` (which ends in a slash)."""
    return Rule(host + path, verdict, rank, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(re.findall(TOKEN, (host + path).lower())))


def pattern_rule(verdict: str, pattern: str, rank: int = 1) -> Rule:
    """A rule written as a small pattern over the lower-cased host followed by the path.

    ``.x.`` is a label of the host above the domain, ``.x`` a word of any label, ``/x`` a whole segment of the path,
    ``/x*`` the head of one, ``*.x`` a suffix of the file, ``a b`` words that stand one after the other; ``#`` is a run
    of digits and may be empty.
    """
    body = re.escape(pattern.strip(".*/")).replace(r"\#", "[0-9]*").replace(r"\ ", "[^A-Za-z0-9]+")
    if pattern.startswith("*."):
        made = rf"/[^/]*\.(?i:{body})$"
    elif pattern.startswith(".") and pattern.endswith("."):
        made = rf"^(?:[^/]*\.)?{body}\.[^/.]+\."
    elif pattern.startswith("."):
        made = rf"^(?:[^/]*[.-])?{body}(?:[.-][^/]*)?(?:/|$)"
    elif pattern.endswith("*"):
        made = rf"^[^/]+/(?:[^/]*/)*(?i:{body})"
    elif pattern.startswith("/"):
        made = rf"^[^/]+/(?:[^/]*/)*(?i:{body})(?:/|\.[a-z]+$|$)"
    else:
        made = rf"(?:^|[^A-Za-z0-9])(?i:{body})(?:$|[^A-Za-z0-9])"
    return Rule(pattern, verdict, rank, made, tuple(re.findall(TOKEN, pattern.lower())))


BASE = (
    host_rule("block", "net", "/"),
    host_rule("allow", "example.net", "/en/"),
    host_rule("block", "example.com", "/de/"),
    host_rule("allow", "org", "/fr/"),
)

#: The method's own rules, for URLs that no base rule fits: what they point at is no text to learn from.
HOST_WORDS = "casino casinos poker porn xxx adult viagra cialis warez torrent torrents camgirls escorts betting sportsbook payday adserver doubleclick sedoparking"
HOST_LABELS = """
ad# ads# adserver# adserv adservice adservices adclick adimg adlog adsrv adnetwork adsystem adtrack adtech adtag adx banner# banners beacon# bannerads clicks# clicktrack
counter# count# creatives cdn-ads conversion cpc cpm dsp impression impressions metrics# pixel# pixels popads popunder popup pops promo# retarget rtb ssp stats# statistics
syndication tag# tags telemetry track# tracker# trackers tracking trk analytics# weblog webstats affiliate affiliates partners-ads sponsor sponsored
casino casinos poker slots bingo roulette betting bets sportsbook jackpot lottery porn xxx adult escorts webcams camgirls hentai milf
warez cracks keygens torrents torrent serialz nulled pharma viagra cialis payday loans-now replica-watches
parked parking forsale domainparking sedoparking webmail mail# smtp# imap# autodiscover cpanel whm plesk phpmyadmin login signin sso auth accounts oauth secure-login
staging# dev# test# uat# qa# sandbox# localhost status# git svn jenkins grafana kibana
img# images# image# static# assets# cdn# media# thumbs# thumb# avatars gravatar
"""
SEGMENTS = """
login log-in logon signin sign-in signup sign-up register registration logout log-out signout password password-reset forgot-password lost-password reset-password account my-account
myaccount profile-edit user-login wp-login wp-admin wp-cron wp-json xmlrpc administrator admin-ajax cpanel phpmyadmin webmail auth oauth oauth2 sso saml two-factor verify-email
cart basket shopping-cart add-to-cart checkout wishlist compare-products order-status track-order payment payments paypal gift-cards coupons coupon voucher
search-results advanced-search tagcloud sitemap sitemap_index site-map feed rss atom amp-ad trackback pingback print printer-friendly print-version email-friend
share sharer share-this tell-a-friend bookmark unsubscribe opt-out optout newsletter-signup subscribe-now cgi-bin cgi scripts ajax api graphql rpc webhook
captcha recaptcha challenge cdn-cgi error404 404 403 500 maintenance coming-soon under-construction test-page hello-world lorem-ipsum default-page
ads ad adserver adframe banner banners popunder popup pixel beacon track tracker tracking redirect redir out goto exit outgoing click clickthrough affiliate affiliates sponsored
privacy-policy privacy cookie-policy cookies terms-of-service terms-of-use terms-and-conditions tos legal-notice imprint impressum disclaimer dmca accessibility-statement
casino poker slots blackjack roulette betting jackpot porn xxx nude escorts hookup camgirls viagra cialis levitra tramadol payday-loan payday-loans
keygen crack cracks serial-key warez nulled torrent torrents magnet-links free-download-full
"""
FILES = """
jpg jpeg png gif bmp ico svg webp tif tiff psd mp3 mp4 m4a m4v avi mov mkv webm wmv flv wav ogg flac zip rar 7z tar gz bz2 xz tgz iso dmg exe msi apk deb rpm bin jar war dll
css js json xml woff woff2 ttf eot otf swf map dat sql bak torrent nzb ics vcf kml gpx shp dwg
"""
PHRASES = (
    "spam farm", "link farm", "ads track", "adult x", "buy now cheap", "cheap viagra", "cheap cialis", "online casino", "casino bonus", "free spins", "poker online", "slots online",
    "sports betting", "bet now", "payday loan", "quick cash", "fast cash loan", "work from home", "make money fast", "get rich", "lose weight fast", "diet pills", "male enhancement",
    "replica watches", "fake passport", "essay writing service", "buy essay", "buy followers", "buy likes", "buy backlinks", "seo backlinks", "guest post service", "click here now",
    "free download full", "serial key", "license key generator", "crack download", "full version free", "watch online free", "streaming free hd", "free porn", "sex videos", "live sex",
    "nude pics", "escort service", "hot singles", "adult dating", "domain for sale", "buy this domain", "bulk email", "email leads",
)


def rules() -> list[Rule]:
    """The base rules, then the method's own by family."""
    families = [*(f".{x}" for x in HOST_WORDS.split()), *(f".{x}." for x in HOST_LABELS.split()), *(f"/{x}/" for x in SEGMENTS.split()), *(f"*.{x}" for x in FILES.split()), *PHRASES]
    heads = [f"/{x}-*" for x in ("utm", "sessionid", "phpsessid", "jsessionid", "gclid", "fbclid", "aff", "ref-id")]
    return [*BASE, *(pattern_rule("block", p) for p in dict.fromkeys([*families, *heads]))]


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(text: Column) -> Column:
    """Distinct runs of ASCII letters and of digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def index(url_tokens: DataFrame, signatures: list[Rule]) -> DataFrame:
    """(token, k, name, verdict, rank, pattern): each rule under its rarest token in ``url_tokens`` (token)."""
    spark = url_tokens.sparkSession
    flat = spark.createDataFrame([(k, i, t) for k, r in enumerate(signatures) for i, t in enumerate(dict.fromkeys(r.tokens))], "k int, i int, token string")
    named = spark.createDataFrame([(k, r.name, r.verdict, r.rank, r.pattern) for k, r in enumerate(signatures)], "k int, name string, verdict string, rank int, pattern string")
    counts = url_tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = flat.join(counts, "token", "left").groupBy("k").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "i")).alias("token"))
    return rarest.join(named, "k")


def judge(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", signatures: list[Rule] | None = None) -> DataFrame:
    """(page_id, host, path, base rule, matched rule, verdict) for each row of ``pages``."""
    signatures = rules() if signatures is None else signatures
    parsed = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parsed = parsed.withColumn("url", F.concat("host", "path"))
    urls = parsed.select("url").filter("url != ''").distinct()
    tokens = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    # tokens are counted over distinct URLs: a rule is tried once for each of those
    indexed = index(tokens.select("token"), signatures)
    if len(signatures) <= BROADCAST_RULES:
        fetched = tokens.join(F.broadcast(indexed), "token")
    else:
        fetched = tokens.join(indexed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))), on=[F.col("salt") == F.pmod(F.xxhash64("url"), F.lit(16)), tokens.token == indexed.token])
    best = F.struct(-F.col("rank"), F.char_length("name"), -F.col("k"))
    found = fetched.filter(F.expr("regexp_like(url, pattern)")).groupBy("url").agg(F.max_by(F.struct("name", "verdict", "rank"), best).alias("found"))
    judged = skew_join(parsed, found, "url", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.when(F.col("found.rank") == 0, F.col("found.name")).alias("rule"),
        F.coalesce("found.verdict", F.lit("allow")).alias("verdict"),
        F.col("found.name").alias("matched"),
    )
