"""Predicates: metadata filters, look-back windows and selections, as Spark columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import all_of


@dataclass(frozen=True)
class MetadataFilter:
    """Optional conditions on a chunk's or document's metadata; what is empty does not restrict."""

    company_id: str | None = None
    fiscal_year: int | None = None
    fiscal_years: tuple[int, ...] = ()
    fiscal_quarter: str | None = None
    report_type: str | None = None
    section_types: tuple[str, ...] = ()
    document_ids: tuple[str, ...] = ()

    def column(self, at: str = "", year_first: bool = False) -> Column:
        """All conditions together, on columns or struct fields below ``at``; ``year_first`` drops years where there is a year."""
        c = lambda name: F.col(f"{at}{name}")
        tests = []
        if self.company_id:
            tests.append(company_like(c("company_id"), self.company_id))
        if self.fiscal_year:
            tests.append(c("fiscal_year") == self.fiscal_year)
        if self.fiscal_years and not (year_first and self.fiscal_year):
            tests.append(c("fiscal_year").isin(*self.fiscal_years))
        if self.fiscal_quarter:
            tests.append(c("fiscal_quarter") == self.fiscal_quarter)
        if self.report_type:
            tests.append(c("report_type") == self.report_type)
        if self.section_types:
            tests.append(c("section_type").isin(*self.section_types))
        if self.document_ids:
            tests.append(c("document_id").isin(*self.document_ids))
        return all_of(tests)

    def or_else(self, inferred: MetadataFilter) -> MetadataFilter:
        """Explicit conditions before inferred ones; several years only where no single year is known."""
        year = self.fiscal_year or inferred.fiscal_year
        return replace(
            self,
            company_id=self.company_id or inferred.company_id,
            fiscal_year=year,
            fiscal_years=() if year else inferred.fiscal_years,
            section_types=self.section_types or inferred.section_types,
        )


def company_like(col: Column, company: str) -> Column:
    """Case-insensitive match with spaces as underscores, which stand for any one character."""
    return col.ilike(company.replace(" ", "_"))


def file_starts(col: Column, prefix: str) -> Column:
    """Whether a file name begins with a text, as it is."""
    return col.startswith(prefix)


def file_has(col: Column, part: str) -> Column:
    """Whether a file name has a text anywhere in it, whatever its case."""
    return F.lower(col).contains(part.lower())


def any_keyword(col: Column, keywords: tuple[str, ...]) -> Column:
    """Whether a text has one of the keywords, whatever their case."""
    quoted = "|".join("\\Q" + k.replace("\\E", "\\E\\\\E\\Q") + "\\E" for k in keywords)
    return col.rlike("(?iu)" + quoted) if keywords else F.lit(True)


def within_days(at: Column, as_of: Column, days: int) -> Column:
    """At most so many whole days old; what has no date is kept."""
    return at.isNull() | (F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400) <= days)


def not_before(at: Column, as_of: Column, days: int) -> Column:
    """Not before the same time so many days ago; what has no date is kept."""
    return at.isNull() | (at >= as_of - F.make_dt_interval(F.lit(days)))


def without_nulls(m: Column) -> Column:
    return F.map_filter(m, lambda _, v: v.isNotNull())


def ratio_subset(m: Column, family: tuple[str, ...], requested: tuple[str, ...] = ()) -> Column:
    """Date, period and the requested ratios of a family, all of it if none are requested; unknown names are ignored."""
    wanted = [r for r in family if not requested or r in requested]
    return F.map_filter(m, lambda k, _: k.isin("date", "period", *wanted))
