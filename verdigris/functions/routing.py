"""Which domain a question belongs to, and the fields and times that it names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the five domains, and phrases of a time range.
PRICE_WORDS = (
    "price", "stock price", "share price", "open", "high", "low", "close", "volume", "ohlc", "market cap", "market capitalization", "pe ratio", "p/e",
    "price to earnings", "dividend", "yield", "historical", "time series", "trading", "quote", "quotes", "index", "indices",
)
SCREEN_WORDS = (
    "top", "largest", "biggest", "highest", "best", "smallest", "lowest", "bottom", "find", "screen", "filter", "show me", "list", "companies with", "stocks with",
    "above", "below", "over", "under", "greater than", "less than", "more than", "at least", "in the", "constituents", "members of", "members", "s&p 500", "s&p500",
    "sp500", "nasdaq", "dow jones", "ftse", "russell", "tech", "healthcare", "financial", "energy", "value", "growth", "dividend", "undervalued",
)
ESTIMATE_WORDS = (
    "estimate", "forecast", "projection", "consensus", "eps", "earnings", "revenue", "sales", "ebitda", "analyst", "rating", "recommendation", "buy", "sell", "hold",
    "price target", "target price", "surprise", "beat", "miss", "revision", "upgrade", "downgrade", "forward pe", "peg ratio", "valuation", "ltg", "long-term growth",
)
FUNDAMENTAL_WORDS = (
    "revenue", "sales", "net income", "profit", "earnings", "gross profit", "operating income", "ebit", "ebitda", "cost of goods", "cogs", "expenses", "margin", "assets",
    "liabilities", "equity", "debt", "cash", "balance sheet", "receivables", "inventory", "payables", "cash flow", "operating cash", "free cash flow", "fcf", "capex",
    "capital expenditure", "dividends paid", "roe", "roa", "current ratio", "quick ratio", "debt to equity", "profit margin", "gross margin", "return on", "leverage",
    "per share", "eps", "dps", "bvps", "fundamentals", "financials", "financial data", "annual report", "quarterly report", "fiscal",
)
OFFICER_WORDS = (
    "ceo", "cfo", "coo", "cto", "cio", "chief executive", "chief financial", "chief operating", "president", "chairman", "chairperson", "executive", "officer", "management",
    "leadership", "who runs", "who leads", "who is the", "board", "director", "board member", "governance", "independent director", "board size", "salary", "compensation",
    "bonus", "pay", "stock awards", "total comp", "tenure", "how long", "education", "university", "background", "biography", "bio",
)
#: Fields of estimates by phrase.
ESTIMATE_FIELDS = {
    "eps": "TR.EPSMean", "earnings per share": "TR.EPSMean", "earnings": "TR.EPSMean", "revenue": "TR.RevenueMean", "sales": "TR.RevenueMean", "ebitda": "TR.EBITDAMean",
    "ebit": "TR.EBITMean", "operating income": "TR.EBITMean", "net income": "TR.NetProfitMean", "net profit": "TR.NetProfitMean", "profit": "TR.NetProfitMean",
    "free cash flow": "TR.FCFMean", "fcf": "TR.FCFMean", "cash flow per share": "TR.CFPSMean", "cfps": "TR.CFPSMean", "dividend": "TR.DPSMean", "dps": "TR.DPSMean",
    "dividend per share": "TR.DPSMean", "book value": "TR.BVPSMean", "book value per share": "TR.BVPSMean", "bvps": "TR.BVPSMean", "roe": "TR.ROEMean",
    "return on equity": "TR.ROEMean", "roa": "TR.ROAMean", "return on assets": "TR.ROAMean", "long term growth": "TR.LTGMean", "ltg": "TR.LTGMean",
}
#: Phrases of an estimate's period, the first that occurs deciding; else the next fiscal year.
ESTIMATE_PERIODS = (
    ("FQ1", ("next quarter", "quarterly", "q1", "q2", "q3", "q4")), ("FQ0", ("last quarter", "previous quarter")), ("FY2", ("next year", "fy2", "two years")), ("FY3", ("three years", "fy3")),
)
SCREEN_BOOST = ("top ", "largest ", "find ", "screen ")
TIME_RANGES = (
    (r"past (\d+) year", "-{}Y", "0D", "D"), (r"last (\d+) year", "-{}Y", "0D", "D"), (r"(?:for |over )?the past year", "-1Y", "0D", "D"),
    (r"past (\d+) month", "-{}M", "0D", "D"), (r"last (\d+) month", "-{}M", "0D", "D"), (r"last (\d+) day", "-{}D", "0D", "D"), (r"past (\d+) day", "-{}D", "0D", "D"),
    (r"past (\d+) week", "-{}W", "0D", "D"), (r"yesterday", "-1D", "-1D", None), (r"last week", "-1W", "0D", "D"), (r"last month", "-1M", "0D", "D"),
    (r"ytd|year.to.date", "-0Y", "0D", "D"), (r"historical|time series|history", "-1Y", "0D", "D"),
)


def hits(question: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur in the question, anywhere in it."""
    low = F.lower(question)
    return sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))


def domain_score(question: Column, words: tuple[str, ...]) -> Column:
    n = hits(question, words)
    return F.when(n >= 3, 0.9).when(n == 2, 0.7).when(n == 1, 0.5).otherwise(0.0)


def price_score(question: Column) -> Column:
    return domain_score(question, PRICE_WORDS)


def screen_score(question: Column) -> Column:
    boosted = F.lower(question).rlike("|".join(SCREEN_BOOST))
    n = hits(question, SCREEN_WORDS) + F.when(boosted, 2).otherwise(0)
    return F.when(n >= 4, 0.9).when(n == 3, 0.8).when(n == 2, 0.7).when(n == 1, 0.5).otherwise(0.0)


def domain_scores(question: Column) -> dict[str, Column]:
    """All five domains, in the order in which they are asked."""
    return {
        "price": price_score(question), "estimates": domain_score(question, ESTIMATE_WORDS), "fundamentals": domain_score(question, FUNDAMENTAL_WORDS),
        "officers": domain_score(question, OFFICER_WORDS), "screening": screen_score(question),
    }


def route(scores: dict[str, Column], least: float = 0.7) -> Column:
    """struct(domain, score): the first domain with the best score; ``unknown`` where that is below ``least``."""
    best = F.greatest(*scores.values())
    domain = F.lit(None).cast("string")
    for name, score in reversed(list(scores.items())):
        domain = F.when(score == best, name).otherwise(domain)
    return F.struct(F.when(best >= least, domain).otherwise("unknown").alias("domain"), best.alias("score"))


def fields(question: Column, categories: list[dict[str, str]], default: str = "P") -> Column:
    """One field of each category, by its longest phrase that occurs; the default where none does."""
    low = F.lower(question)
    found = []
    for table in categories:
        pick = F.lit(None).cast("string")
        for phrase in sorted(table, key=len):
            pick = F.when(F.contains(low, F.lit(phrase)), table[phrase]).otherwise(pick)
        found.append(pick)
    out = F.array_distinct(F.array_compact(F.array(*found)))
    return F.when(F.size(out) == 0, F.array(F.lit(default))).otherwise(out)


def named_fields(question: Column, fields: dict[str, str]) -> Column:
    """The fields whose phrases occur as whole words, each once, those of longer phrases first."""
    low = F.lower(question)
    ordered = sorted(fields, key=lambda phrase: -len(phrase))
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.rlike(r"\b" + re.escape(p) + r"\b"), fields[p]) for p in ordered])))


def estimate_period(question: Column) -> Column:
    """FQ0, FQ1, FY1, FY2 or FY3."""
    low = F.lower(question)
    out = F.lit("FY1")
    for period, phrases in reversed(ESTIMATE_PERIODS):
        out = F.when(low.rlike("|".join(phrases)), period).otherwise(out)
    return out


def fundamental_period(question: Column) -> Column:
    """struct(start, end, period, freq): the last N years as a series, a quarter, or a fiscal year."""
    low = F.lower(question)
    nothing = F.lit(None).cast("string")
    years = F.nullif(F.regexp_extract(low, r"(?:last|past)\s+(\d+)\s+years?", 1), F.lit("")).cast("long")
    made = lambda start, end, period, freq: F.struct(start.alias("start"), end.alias("end"), period.alias("period"), freq.alias("freq"))
    series = made(F.lit("0"), F.concat(F.lit("-"), (years - 1).cast("string")), nothing, F.lit("FY"))
    quarter = made(nothing, nothing, F.when(low.rlike("last quarter|previous quarter"), "FQ-1").otherwise("FQ0"), F.lit("FQ"))
    year = made(nothing, nothing, F.lit("FY0"), F.when(low.rlike("last year|fiscal year"), "FY"))
    return F.when(years.isNotNull(), series).when(low.rlike("quarter|q1|q2|q3|q4"), quarter).otherwise(year)


def time_range(question: Column) -> Column:
    """struct(start, end, freq) of the first phrase that fits, with another frequency where one is named; null without any."""
    low = F.lower(question)
    nothing = F.lit(None).cast("string")
    start = end = freq = nothing
    for pattern, s, e, f in reversed(TIME_RANGES):
        here = low.rlike(pattern)
        value = F.concat(F.lit(s.partition("{}")[0]), F.regexp_extract(low, pattern, 1), F.lit(s.partition("{}")[2])) if "{}" in s else F.lit(s)
        start, end, freq = F.when(here, value).otherwise(start), F.when(here, e).otherwise(end), F.when(here, F.lit(f)).otherwise(freq)
    freq = F.when(F.contains(low, F.lit("weekly")), "W").when(F.contains(low, F.lit("monthly")), "M").when(F.contains(low, F.lit("quarterly")), "Q").when(low.rlike("annual|yearly"), "Y").otherwise(freq)
    return F.when(start.isNotNull() | freq.isNotNull(), F.struct(start.alias("start"), end.alias("end"), freq.alias("freq")))
