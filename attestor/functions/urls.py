"""URL functions: canonical forms (F04), raw representations (S08), specification candidates."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where an origin usually keeps its specification.
SPEC_PATHS = ["/openapi.json", "/swagger.json", "/v3/api-docs", "/api-docs"]


def page_url(url: Column) -> Column:
    """A page without its fragment and trailing slashes (variant b)."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def strict_url(url: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash, query kept; null with credentials or another scheme (variant c)."""
    parts = F.regexp_extract
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    scheme, host, path = F.lower(parts(url, pattern, 1)), F.lower(parts(url, pattern, 2)), parts(url, pattern, 3)
    valid = scheme.isin("http", "https") & (host != "") & ~host.contains("@")
    return F.when(valid, F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, "/+$", ""), parts(url, pattern, 4)))


def origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


@F.pandas_udf(T.StringType())
def same_origin_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """A link resolved against its page, without fragment and trailing slash; null on another origin (variant a)."""

    def one(b: str | None, h: str | None) -> str | None:
        if b is None or h is None:
            return None
        try:
            page, target = urlsplit(b), urlsplit(urljoin(b, h.strip()))
        except ValueError:
            return None
        if (page.scheme, page.netloc) != (target.scheme, target.netloc) or target.scheme not in ("http", "https"):
            return None
        return target._replace(path=target.path.rstrip("/"), fragment="").geturl()

    return pd.Series([one(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def fetch_target(url: Column) -> Column:
    """The raw representation of a note page (its download), else the URL itself."""
    note = F.regexp_extract(url, r"^https?://hackmd\.io/((?:@[^/?#]+/)?[^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(note != "", F.concat(F.lit("https://hackmd.io/"), note, F.lit("/download"))).otherwise(url)


def spec_candidates(url: Column) -> Column:
    """The well-known specification URLs of a page's origin."""
    return F.transform(F.array(*map(F.lit, SPEC_PATHS)), lambda p: F.concat(origin(url), p))


def is_spec(raw: Column) -> Column:
    """Whether a text is a JSON object with a string ``openapi`` or ``swagger``."""
    v = F.try_parse_json(raw)
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.lit(False))
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)) & (kind("openapi") | kind("swagger"))


def openapi_signal(raw: Column) -> Column:
    """(is_openapi, version) of a JSON text: Swagger 2.0 or OpenAPI 3.x, and the version its info states, if that is a string."""
    v = F.try_parse_json(raw)
    said = lambda path: F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))
    is_api = F.coalesce(said("$.swagger") == "2.0", F.lit(False)) | F.coalesce(said("$.openapi").startswith("3."), F.lit(False))
    return F.struct(is_api.alias("is_openapi"), F.when(is_api, said("$.info.version")).alias("version"))
