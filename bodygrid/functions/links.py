"""Citation text and safe links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_citation(authors: Column, year: Column, title: Column, venue: Column, id_kind: Column, id_value: Column) -> Column:
    n = F.size(authors)
    who = (
        F.when(n == 0, "[no author recorded]")
        .when(n <= 2, F.array_join(authors, " & "))
        .otherwise(F.concat(F.get(authors, F.lit(0)), F.lit(" et al.")))
    )
    ident = F.when((id_kind == "none") | id_value.isNull(), "no persistent identifier recorded").otherwise(
        F.concat(F.upper(id_kind), F.lit(" "), id_value)
    )
    return F.concat(who, F.lit(" ("), year.cast("string"), F.lit("). "), title, F.lit(". "), venue, F.lit(". "), ident, F.lit("."))


def is_safe_url(url: Column) -> Column:
    """Absolute http or https with a host and without a control character or blank."""
    clean = ~url.rlike("[\\x00-\\x20\\x7f-\\x9f]")
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(clean & scheme.isin("http", "https") & (F.coalesce(host, F.lit("")) != ""), F.lit(False))


def safe_href(url: Column) -> Column:
    return F.when(is_safe_url(url), url)


def unlinked_reason(url: Column) -> Column:
    return F.when(~is_safe_url(url), F.when(F.coalesce(url, F.lit("")) == "", "no source URL recorded").otherwise("source URL rejected: not an absolute http(s) URL"))
