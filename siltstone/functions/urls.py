"""Canonical form, hash, host and kind of links, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, and hosts by kind.
TRACKING = ["si", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "feature", "ref", "ref_src", "lang", "app"]
PAPER_HOSTS = ["arxiv.org", "openreview.net"]
TWEET_HOSTS = ["x.com", "twitter.com"]
PAPER_PATH = "huggingface.co/papers"
#: A link in running text; full stops and commas after it do not belong to it.
LINK = r"https?://[^\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}>\)\]]+"
#: Fixed value: a capture's asset lives at an address of this shape.
ASSET = r"^https://api\.github\.com/repos/[^/]+/[^/]+/releases/assets/\d+$"


def _part(url: Column, pattern: str) -> Column:
    return F.regexp_extract(url, pattern, 1)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), F.replace(text, F.lit("+"), F.lit(" ")))


def _encode(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _pairs(query: Column) -> Column:
    """Decoded (name, value) of the parameters that have a value, in order."""
    given = F.filter(F.split(query, "&"), lambda p: p.rlike("=."))
    return F.transform(
        given,
        lambda p: F.struct(
            _decode(F.substring_index(p, "=", 1)).alias("name"), _decode(F.regexp_extract(p, "^[^=]*=((?s).*)$", 1)).alias("value")
        ),
    )


def authority(url: Column) -> Column:
    """The part between // and the path, in lower case."""
    return F.lower(_part(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"))


def canonical(url: Column) -> Column:
    """One spelling for all spellings of a link; null for null and for text without ://.

    https; host in lower case without www. and m.; no trailing slashes, no
    fragment, no tracking or empty parameters; short video links as long ones,
    of whose parameters only the video's stays.
    """
    u = F.regexp_replace(F.trim(url), r"[\t\r\n]", "")

    def parts(u: Column) -> Column:
        site = F.regexp_replace(F.regexp_replace(authority(u), "^www[.]", ""), "^m[.]", "")
        return F.struct(u.alias("u"), site.alias("site"), _part(u, r"^[^:/?#]+://[^/?#]*([^?#]*)").alias("path"))

    def asked(p: Column) -> Column:
        """The parameters that stay, written."""
        video = F.array(F.struct(F.lit("v").alias("name"), F.regexp_replace(p["path"], "^/+", "").alias("value")))
        given = F.when(p["site"] == "youtu.be", video).otherwise(_pairs(_part(p["u"], r"^[^?#]*\?([^#]*)")))
        of_video = p["site"].isin("youtube.com", "youtu.be")
        kept = F.filter(given, lambda x: ~x["name"].isin(TRACKING) & (x["value"] != "") & (~of_video | (x["name"] == "v")))
        query = F.array_join(F.transform(kept, lambda x: F.concat(_encode(x["name"]), F.lit("="), _encode(x["value"]))), "&")
        # most links have no parameters
        return F.when((p["site"] == "youtu.be") | F.contains(p["u"], F.lit("?")), query).otherwise("")

    def whole(p: Column) -> Column:
        short = p["site"] == "youtu.be"
        return _once(asked(p), lambda q: F.concat(
            F.lit("https://"), F.when(short, "youtube.com").otherwise(p["site"]),
            F.when(short, "/watch").otherwise(F.regexp_replace(p["path"], "/+$", "")), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""),
        ))

    return F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), _once(_once(u, parts), whole))


def hash_of(link: Column) -> Column:
    """First ten hexadecimal digits of the SHA-1 of a link in canonical form."""
    return F.left(F.sha1(link), F.lit(10))


def link_hash(url: Column) -> Column:
    """``hash_of`` the canonical form."""
    return hash_of(canonical(url))


def host(url: Column) -> Column:
    """What follows the scheme up to the first slash, in lower case."""
    return F.lower(F.substring_index(F.regexp_replace(url, "^https?://", ""), "/", 1))


def _kind(site: Column, url: Column, video: list[str], code: list[str]) -> Column:
    return (
        F.when(site.isin(video), "youtube")
        .when(site.isin(code), "github")
        .when(site.isin(PAPER_HOSTS) | F.contains(url, F.lit(PAPER_PATH)), "paper")
        .when(site.isin(TWEET_HOSTS), "tweet")
        .when(url.isNotNull(), "blog")
    )


def fetch_kind(url: Column) -> Column:
    """Kind by which a link is fetched."""
    site = F.regexp_replace(authority(url), "^www[.]", "")
    return _kind(site, url, ["youtube.com", "youtu.be"], ["github.com", "gist.github.com"])


def share_kind(url: Column) -> Column:
    """Kind by which a shared link is filed."""
    site = F.regexp_replace(host(url), "^www[.]", "")
    return _kind(site, url, ["youtube.com", "youtu.be", "m.youtube.com"], ["github.com"])


def is_internal(url: Column, domains: list[str]) -> Column:
    """Whether the host is one of ``domains`` or below one."""
    site = host(url)
    tests = [(site == d) | site.endswith("." + d) for d in domains]
    out = F.lit(False)
    for test in tests:
        out = out | test
    return out


def links_in(text: Column) -> Column:
    """Links in running text, in order, repeats included."""
    return F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(0)), lambda u: F.rtrim(u, F.lit(".,")))


def github_route(url: Column) -> Column:
    """What a link to the code host leads to: gist, user, blob, issue, repo or skipped."""
    parts = F.filter(F.split(_part(url, r"^[^:/?#]+://[^/?#]*([^?#]*)"), "/"), lambda p: p != "")
    n, third = F.size(parts), F.try_element_at(parts, F.lit(3))
    return (
        F.when(authority(url).startswith("gist."), F.when(n >= 2, "gist").otherwise("skipped"))
        .when(n == 1, "user").when(n < 2, "skipped")
        .when((n >= 4) & (third == "blob"), "blob")
        .when((n >= 4) & third.isin("issues", "pull"), "issue")
        .otherwise("repo")
    )


def arxiv_id(url: Column) -> Column:
    """Paper number in a link to a preprint, without version; null for other links."""
    return F.nullif(
        F.regexp_extract(canonical(url), r"arxiv\.org/(?:abs|pdf|html)/([\d.]+?)(?:v\d+)?(?:\.pdf)?/?$", 1), F.lit("")
    )


def media_extension(url: Column) -> Column:
    """File ending of a picture's link, jpg if there is none worth keeping."""
    ending = F.lower(F.substring_index(_part(url, r"^[^:/?#]+://[^/?#]*([^?#]*)"), ".", -1))
    ending = F.when(ending == "", "jpg").otherwise(ending)
    return F.when((F.length(ending) > 4) | F.contains(ending, F.lit("/")), "jpg").otherwise(ending)


def repo_of_remote(remote: Column) -> Column:
    """owner/name of a git remote on the code host; null for others."""
    return F.nullif(F.regexp_extract(remote, r"github\.com[:/]([^/]+/[^/]+?)(?:\.git)?$", 1), F.lit(""))


def asset_id(url: Column) -> Column:
    """Number at the end of a release asset's address."""
    return F.regexp_extract(url, r"/assets/(\d+)$", 1).try_cast("bigint")
