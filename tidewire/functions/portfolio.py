"""A financial portfolio document to the text that stands for it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import strip_space

_ACCOUNTS = "map<string,string>"
_HOLDINGS = "$.summary.investment.holdings.holding"
_TEXTS = "array<string>"

# Section order, the phrase each section adds, and the deposit
# section, which comes last and is shaped differently.
SECTION_ORDER = ["EQUITIES", "MUTUALFUNDS", "SIP", "REIT", "INVIT", "INSURANCE_POLICIES"]
DEPOSITS = "DEPOSIT_V2"
THEMES = [
    (["EQUITIES"], "Indian stock market equities shares"),
    (["MUTUALFUNDS", "SIP"], "mutual funds SIP investment"),
    (["REIT"], "real estate investment trust REIT"),
    (["INVIT"], "infrastructure investment trust InvIT"),
    (["INSURANCE_POLICIES"], "insurance life cover financial planning"),
    (["DEPOSIT_V2"], "bank savings deposit interest rate"),
]


def sections_of(document: Column) -> Column:
    """The document's sections as a map; key order is kept."""
    return F.from_json(document, _ACCOUNTS)


def safe(value: Column) -> Column:
    absent = value.isNull() | value.isin("", "null")
    return F.when(absent, F.lit("")).otherwise(strip_space(value))


def _no_texts() -> Column:
    return F.array().cast(_TEXTS)


def _per_account(section: Column, texts: Callable[[Column], Column]) -> Column:
    accounts = F.map_values(F.from_json(section, _ACCOUNTS))
    listed = F.transform(accounts, lambda a: F.coalesce(texts(a), _no_texts()))
    return F.coalesce(F.flatten(listed), _no_texts())


def _per_holding(fields: str, texts: Callable[[Column], list[Column]]) -> Callable[[Column], Column]:
    """Texts of each holding; a lone holding object reads as a list of one."""

    def of_account(account: Column) -> Column:
        raw = F.get_json_object(account, _HOLDINGS)
        holdings = F.from_json(raw, f"array<struct<{fields}>>")
        return F.flatten(F.transform(holdings, lambda h: F.array(*texts(h))))

    return of_account


def equities(section: Column) -> Column:
    return _per_account(
        section,
        _per_holding(
            "issuerName:string,description:string",
            lambda h: [safe(h["issuerName"]), safe(h["description"])],
        ),
    )


def funds(section: Column) -> Column:
    def texts(h: Column) -> list[Column]:
        house = F.coalesce(F.when(h["amc"] != "", h["amc"]), h["issuerName"])
        return [safe(house), safe(h["schemeCode"])]

    return _per_account(
        section, _per_holding("amc:string,issuerName:string,schemeCode:string", texts)
    )


def trusts(section: Column) -> Column:
    return _per_account(
        section, _per_holding("issuerName:string", lambda h: [safe(h["issuerName"])])
    )


def insurance(section: Column) -> Column:
    def texts(account: Column) -> Column:
        policy = F.from_json(
            F.get_json_object(account, "$.summary"),
            "struct<policyName:string,policyType:string,coverType:string>",
        )
        kind = F.lower(F.replace(safe(policy["policyType"]), F.lit("_"), F.lit(" ")))
        return F.array(safe(policy["policyName"]), kind, safe(policy["coverType"]))

    return _per_account(section, texts)


def deposits(section: Column) -> Column:
    items = F.from_json(
        F.get_json_object(section, "$.summary"),
        "array<struct<accountType:string,facility:string,description:string>>",
    )

    def texts(d: Column) -> Column:
        kind = safe(d["accountType"])
        account = F.when(kind != "", F.concat(kind, F.lit(" account"))).otherwise(F.lit(""))
        return F.array(account, safe(d["facility"]), safe(d["description"]))

    return F.coalesce(F.flatten(F.transform(items, texts)), _no_texts())


EXTRACTORS: dict[str, Callable[[Column], Column]] = {
    "EQUITIES": equities,
    "MUTUALFUNDS": funds,
    "SIP": funds,
    "REIT": trusts,
    "INVIT": trusts,
    "INSURANCE_POLICIES": insurance,
    "DEPOSIT_V2": deposits,
}


def portfolio_text(sections: Column, interests: Column) -> Column:
    """Section texts, theme phrases and interests, each text once, in order."""

    def has(name: str) -> Column:
        return F.coalesce(F.map_contains_key(sections, name), F.lit(False))

    extracted = [EXTRACTORS[name](sections[name]) for name in [*SECTION_ORDER, DEPOSITS]]
    themes = []
    for names, phrase in THEMES:
        present = F.array_max(F.array(*[has(n) for n in names]))
        themes.append(F.when(present, F.lit(phrase)).otherwise(F.lit("")))
    extra = strip_space(F.coalesce(interests, F.lit("")))
    parts = F.concat(*extracted, F.array(*themes, extra))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), ". ")


def with_portfolio_text(df: DataFrame) -> DataFrame:
    """Add ``query_text`` to rows with ``portfolio`` and ``interests``.

    The sections are the variable of a function over a list of one: as a column they would
    be put wherever a filter on the text names them, and a document parsed each time. The
    text is the one row of a generator for the same reason: a filter stays above it.
    """
    parsed = F.array(sections_of(F.col("portfolio")))
    return df.withColumn("query_text", F.explode(F.transform(parsed, lambda s: portfolio_text(s, F.col("interests")))))


def section_counts(sections: Column) -> Column:
    """Accounts per present section; deposits count their summary items."""

    def accounts(name: str) -> Column:
        return F.size(F.map_keys(F.from_json(sections[name], _ACCOUNTS)))

    items = F.from_json(F.get_json_object(sections[DEPOSITS], "$.summary"), _TEXTS)
    deposit_count = F.when(
        F.map_contains_key(sections, DEPOSITS), F.coalesce(F.size(items), F.lit(0))
    )
    named = [deposit_count.alias("deposits")]
    for name in SECTION_ORDER:
        count = F.when(F.map_contains_key(sections, name), accounts(name))
        named.append(count.alias(name.lower()))
    return F.struct(*named)
