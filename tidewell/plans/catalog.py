"""The declarative surface: metrics, ratios and growth rates as data, checked when the module loads."""

from __future__ import annotations

from dataclasses import dataclass

# Entity codes and names, and the codes that reports use by default.
ENTITIES = {
    "10001": "Sector",
    "10002": "Deposit Banks",
    "10003": "Private Deposit Banks",
    "10004": "State Deposit Banks",
    "10005": "Foreign Deposit Banks",
    "10006": "Participation Banks",
    "10007": "Dev & Investment Banks",
    "10008": "Domestic Private (All)",
    "10009": "Public Banks (All)",
    "10010": "Foreign Banks (All)",
}
PRIMARY = ("10001", "10003", "10004", "10005", "10006", "10007")
SECTOR = "10001"
CURRENCIES = ("TL", "FX", "TOTAL")
CATEGORIES = ("assets", "credit", "deposits", "capital", "liabilities", "asset_quality", "liquidity", "currency", "growth", "off_balance")


@dataclass(frozen=True)
class Where:
    """Item names: any of ``like`` and none of ``unlike``, and equal columns."""

    like: tuple[str, ...] = ()
    unlike: tuple[str, ...] = ()
    equal: tuple[tuple[str, int | str], ...] = ()


@dataclass(frozen=True)
class Metric:
    id: str
    name: str
    category: str
    table: str
    where: Where
    #: Currency -> columns that are added before they are summed; a row where one is null doesn't count.
    columns: dict[str, tuple[str, ...]]
    unit: str = "million_tl"
    #: How the rows of a month and entity are put together: sum, avg, min, max or count.
    aggregation: str = "sum"

    def of(self, currency: str) -> tuple[str, ...]:
        got = self.columns.get(currency) or self.columns.get("TOTAL")
        if not got:
            raise ValueError(f"{self.id} has neither {currency} nor TOTAL")
        return got


@dataclass(frozen=True)
class Ratio:
    id: str
    name: str
    category: str
    numerator: str
    denominator: str
    scale: float = 100.0


@dataclass(frozen=True)
class Growth:
    id: str
    name: str
    metric: str
    periods: int


_AMOUNTS = {"TL": ("amount_tl",), "FX": ("amount_fx",), "TOTAL": ("amount_total",)}
_TOTAL = {"TOTAL": ("amount_total",)}
_TABLE3 = Where(("%TOPLAM%",), equal=(("table_number", 3),))

# Ids, item name patterns and columns of the 18 metrics, 7 ratios and 7 growth rates.
METRICS = {m.id: m for m in (
    Metric("total_assets", "Total Assets", "assets", "balance_sheet", Where(("%TOPLAM AKT%",)), _AMOUNTS),
    Metric("cash_and_central_bank", "Cash & Central Bank", "assets", "balance_sheet", Where(("%Nakit%", "%Merkez Bankası%Alacak%")), _AMOUNTS),
    Metric("securities_portfolio", "Securities Portfolio", "assets", "balance_sheet", Where(("%Menkul%Değ%", "%Menk%Kıymet%")), _AMOUNTS),
    Metric("total_loans", "Total Loans", "credit", "loans", _TABLE3, {"TL": ("total_tl",), "FX": ("total_fx",), "TOTAL": ("total_amount",)}),
    Metric("loans_short_term", "Short-term Loans", "credit", "loans", _TABLE3, {"TL": ("short_term_tl",), "FX": ("short_term_fx",), "TOTAL": ("short_term_total",)}),
    Metric("loans_medium_long_term", "Medium/Long-term Loans", "credit", "loans", _TABLE3, {"TL": ("medium_long_tl",), "FX": ("medium_long_fx",), "TOTAL": ("medium_long_total",)}),
    Metric("npl_amount", "Non-Performing Loans", "credit", "loans", _TABLE3, {"TOTAL": ("npl_amount",)}),
    Metric("customer_count", "Loan Customer Count", "credit", "loans", _TABLE3, {"TOTAL": ("customer_count",)}, "count"),
    Metric("total_deposits", "Total Deposits", "deposits", "balance_sheet", Where(("%Mevduat%",), ("%Faiz%",)), _AMOUNTS),
    Metric("demand_deposits", "Demand Deposits", "deposits", "deposits", Where(("%TOPLAM%",)), {"TOTAL": ("demand",)}),
    Metric("time_deposits", "Time Deposits", "deposits", "deposits", Where(("%TOPLAM%",)), {"TOTAL": ("maturity_1m", "maturity_1_3m", "maturity_3_6m", "maturity_6_12m", "maturity_over_12m")}),
    Metric("total_equity", "Total Equity", "capital", "balance_sheet", Where(("%TOPLAM ÖZKAYN%",)), _TOTAL),
    Metric("paid_in_capital", "Paid-in Capital", "capital", "balance_sheet", Where(("%Ödenmiş Sermaye%",)), _TOTAL),
    Metric("retained_earnings", "Retained Earnings", "capital", "balance_sheet", Where(("%Yedek%", "%Kar%")), _TOTAL),
    Metric("total_liabilities", "Total Liabilities", "liabilities", "balance_sheet", Where(("%TOPLAM YABANCI KAYN%",)), _TOTAL),
    Metric("borrowings_from_banks", "Borrowings from Banks", "liabilities", "balance_sheet", Where(("%Bankalara Borç%",)), _AMOUNTS),
    Metric("non_cash_loans", "Non-Cash Loans (Guarantees)", "off_balance", "balance_sheet", Where(("%Gayrinakdi%",)), _TOTAL),
    Metric("derivative_instruments", "Derivative Instruments", "off_balance", "balance_sheet", Where(("%Türev%",)), _TOTAL),
)}
#: What ratios and growth rates take for these ids: the balance-sheet lines, not the loan table.
GETTERS = {m.id: m for m in (
    Metric("total_loans", "Total Loans", "credit", "balance_sheet", Where(("Krediler%",)), _AMOUNTS),
    Metric("npl_amount", "Non-Performing Loans", "credit", "balance_sheet", Where(("%Takipteki Alacak%",)), _AMOUNTS),
    Metric("total_deposits", "Total Deposits", "deposits", "balance_sheet", Where(("%Mevduat%Fon%",), ("%Faiz%", "%a)%", "%b)%")), _AMOUNTS),
)}
RATIOS = {r.id: r for r in (
    Ratio("npl_ratio", "NPL Ratio", "asset_quality", "npl_amount", "total_loans"),
    Ratio("loan_to_deposit_ratio", "Loan to Deposit Ratio", "liquidity", "total_loans", "total_deposits"),
    Ratio("equity_ratio", "Equity Ratio", "capital", "total_equity", "total_assets"),
    Ratio("fx_loan_share", "FX Loan Share", "currency", "total_loans[FX]", "total_loans[TOTAL]"),
    Ratio("fx_deposit_share", "FX Deposit Share", "currency", "total_deposits[FX]", "total_deposits[TOTAL]"),
    Ratio("demand_deposit_share", "Demand Deposit Share", "liquidity", "demand_deposits", "total_deposits"),
    Ratio("short_term_loan_share", "Short-term Loan Share", "credit", "loans_short_term", "total_loans"),
)}
GROWTH = {g.id: g for g in (
    Growth("asset_growth_yoy", "Asset Growth (YoY)", "total_assets", 12),
    Growth("asset_growth_mom", "Asset Growth (MoM)", "total_assets", 1),
    Growth("loan_growth_yoy", "Loan Growth (YoY)", "total_loans", 12),
    Growth("loan_growth_mom", "Loan Growth (MoM)", "total_loans", 1),
    Growth("deposit_growth_yoy", "Deposit Growth (YoY)", "total_deposits", 12),
    Growth("deposit_growth_mom", "Deposit Growth (MoM)", "total_deposits", 1),
    Growth("npl_growth_yoy", "NPL Growth (YoY)", "npl_amount", 12),
)}


def operand(text: str) -> tuple[str, str]:
    """'id[CUR]' -> (id, CUR); without a currency TOTAL."""
    name, _, rest = text.partition("[")
    return name, rest.rstrip("]") or "TOTAL"


def get(id: str) -> Metric | Ratio | Growth:
    for table in (METRICS, RATIOS, GROWTH):
        if id in table:
            return table[id]
    raise KeyError(f"no metric {id!r}; known: {', '.join(sorted([*METRICS, *RATIOS, *GROWTH]))}")


def by_category(category: str) -> list[str]:
    return [d.id for t in (METRICS, RATIOS) for d in t.values() if d.category == category] + ([*GROWTH] if category == "growth" else [])


def list_all() -> dict[str, list[str]]:
    return {c: by_category(c) for c in CATEGORIES}


def markdown() -> str:
    """The catalogue as a document."""
    out = ["# Metrics", "", "| id | name | kind | definition |", "|---|---|---|---|"]
    out += [f"| {m.id} | {m.name} | metric | {m.table}: {' or '.join(m.where.like)} |" for m in METRICS.values()]
    out += [f"| {r.id} | {r.name} | ratio | {r.numerator} / {r.denominator} x {r.scale:g} |" for r in RATIOS.values()]
    out += [f"| {g.id} | {g.name} | growth | {g.metric} over {g.periods} months |" for g in GROWTH.values()]
    return "\n".join(out) + "\n"


for _m in (*METRICS.values(), *GETTERS.values()):
    if _m.aggregation not in ("sum", "avg", "min", "max", "count"):
        raise ValueError(f"{_m.id}: unknown aggregation {_m.aggregation}")
for _r in RATIOS.values():
    for _o in (_r.numerator, _r.denominator):
        if operand(_o)[0] not in METRICS or operand(_o)[1] not in CURRENCIES:
            raise ValueError(f"{_r.id}: unknown operand {_o}")
for _g in GROWTH.values():
    if _g.metric not in METRICS:
        raise ValueError(f"{_g.id}: unknown metric {_g.metric}")
