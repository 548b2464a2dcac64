"""Named series: where each comes from, its code there, label, kind and unit."""

from __future__ import annotations

from dataclasses import dataclass
from difflib import get_close_matches

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.expr import ascii_like


@dataclass(frozen=True)
class Series:
    key: str
    #: external (code), weekly (item id), ratio and balance (item name patterns).
    source: str
    code: str
    label: str
    kind: str = ""
    unit_scale: float = 1.0
    direction: str = ""


# Keys, sources, codes, labels, kinds, unit divisors and directions, in the order of their groups.
SERIES = {s.key: s for s in (
    Series("policy_rate", "external", "TP.PY.P02.1H", "Policy Rate", "step"),
    Series("on_lending", "external", "TP.PY.P02.ON", "ON Lending", "step"),
    Series("on_borrowing", "external", "TP.PY.P01.ON", "ON Borrowing", "step"),
    Series("bist_tlref", "external", "TP.BISTTLREF.ORAN", "BIST TRY REF", "daily"),
    Series("cbrt_funding_cost", "external", "TP.APIFON4", "Effective Funding Cost", "daily"),
    Series("week_auction_avg", "external", "TP.PY.P06.1HI", "1-Week Auction Avg", "daily"),
    Series("rate_consumer", "external", "TP.KTFTUK", "Consumer loan", "weekly"),
    Series("rate_consumer_incl_od", "external", "TP.KTFTUK01", "Consumer loan (incl. overdraft)", "weekly"),
    Series("rate_commercial", "external", "TP.KTF18", "Commercial (ex cards & OD)", "weekly"),
    Series("rate_commercial_all", "external", "TP.KTF17", "Commercial Loans (all)", "weekly"),
    Series("rate_personal", "external", "TP.KTF10", "Personal loans", "weekly"),
    Series("rate_vehicle", "external", "TP.KTF11", "Vehicle loans", "weekly"),
    Series("rate_housing", "external", "TP.KTF12", "Housing loans", "weekly"),
    Series("rate_deposit_total_tl", "external", "TP.TRY.MT06", "Deposit (total TL)", "weekly"),
    Series("rate_deposit_1m", "external", "TP.TRY.MT01", "Deposit ≤1m", "weekly"),
    Series("rate_deposit_3m", "external", "TP.TRY.MT02", "Deposit ≤3m", "weekly"),
    Series("rate_deposit_6m", "external", "TP.TRY.MT03", "Deposit ≤6m", "weekly"),
    Series("rate_deposit_12m", "external", "TP.TRY.MT04", "Deposit ≤1y", "weekly"),
    Series("rate_deposit_over_12m", "external", "TP.TRY.MT05", "Deposit >1y", "weekly"),
    Series("rate_fc_loan_usd", "external", "TP.KTF17.USD", "Commercial Loan (USD)", "weekly"),
    Series("rate_fc_loan_eur", "external", "TP.KTF17.EUR", "Commercial Loan (EUR)", "weekly"),
    Series("rate_fc_dep_usd", "external", "TP.USD.MT06", "Total USD Deposit", "weekly"),
    Series("rate_fc_dep_eur", "external", "TP.EUR.MT06", "Total EUR Deposit", "weekly"),
    Series("usd_try", "external", "TP.DK.USD.A", "USD/TRY (buying)", "daily"),
    Series("eur_try", "external", "TP.DK.EUR.A", "EUR/TRY (buying)", "daily"),
    Series("cbrt_base_money_tl", "external", "TP.AB.N01", "CBRT Base Money", "weekly"),
    Series("cbrt_nir_tl", "external", "TP.AB.N06", "Net Intl Reserves (TL)", "weekly"),
    Series("cbrt_gross_fx_assets", "external", "TP.AB.N07", "Gross Foreign Assets", "weekly"),
    Series("cbrt_fx_liabilities", "external", "TP.AB.N08", "Gross Reserve Liabilities", "weekly"),
    Series("cpi_index", "external", "TP.FG.J0", "CPI (2003=100)", "monthly"),
    Series("fc_dep_residents", "external", "TP.HPBITABLO4.2", "Residents total FC deposits", "weekly"),
    Series("fc_dep_households", "external", "TP.HPBITABLO4.3", "Households total FC", "weekly"),
    Series("fc_dep_hh_usd", "external", "TP.HPBITABLO4.4", "Households USD", "weekly"),
    Series("fc_dep_hh_eur", "external", "TP.HPBITABLO4.5", "Households EUR (in USD eq)", "weekly"),
    Series("fc_dep_hh_pm", "external", "TP.HPBITABLO4.7", "Households Precious Metals", "weekly"),
    Series("mps_cpi_curr_ye", "external", "TP.PKAUO.S01.D.U", "CPI Exp, current year-end", "monthly"),
    Series("mps_cpi_next_ye", "external", "TP.PKAUO.S01.I.U", "CPI Exp, next year-end", "monthly"),
    Series("mps_cpi_12m", "external", "TP.PKAUO.S01.E.U", "CPI Exp, 12m ahead", "monthly"),
    Series("mps_policy_12m", "external", "TP.PKAUO.S04.D.U", "Policy Rate Exp, 12m ahead", "monthly"),
    Series("hh_inflation_12m", "external", "TP.HANEBEK.HAN14A", "Household 12m CPI Expectation", "monthly"),
    Series("cbrt_total_assets", "external", "TP.AB.A01", "CBRT Total Assets", "daily"),
    Series("cbrt_foreign_assets", "external", "TP.AB.A02", "CBRT Foreign Assets", "daily"),
    Series("cbrt_domestic_assets", "external", "TP.AB.A03", "CBRT Domestic Assets", "daily"),
    Series("cbrt_gov_securities", "external", "TP.AB.A051", "CBRT Domestic Securities", "daily"),
    Series("cbrt_steril_total", "external", "TP.APIFON2.TOP", "Total Sterilization", "daily", unit_scale=1000.0),
    Series("cbrt_steril_auction", "external", "TP.APIFON2.IHA", "TL Deposits (auction)", "daily", unit_scale=1000.0),
    Series("cbrt_steril_quotation", "external", "TP.APIFON2.KOT", "Quotation", "daily", unit_scale=1000.0),
    Series("cbrt_steril_liqbills", "external", "TP.APIFON2.LIK", "Liquidity Bills", "daily", unit_scale=1000.0),
    Series("cbrt_net_funding", "external", "TP.APIFON3", "CBRT Net Funding", "daily", unit_scale=1000.0),
    Series("cbrt_gold_total_tons", "external", "TP.BL0021", "CBRT Gold Assets (tons)", "weekly", unit_scale=1000000000.0),
    Series("cbrt_gold_banks_tons", "external", "TP.BL0891", "Banks' Gold at CBRT (tons)", "weekly", unit_scale=1000000000.0),
    Series("cbrt_gross_reserves", "external", "TP.AB.TOPLAM", "Gross Reserves", "weekly"),
    Series("cbrt_reserves_gold", "external", "TP.AB.C1", "Gold Reserves", "weekly"),
    Series("cbrt_reserves_fx", "external", "TP.AB.C2", "FX Reserves", "weekly"),
    Series("cbrt_bs_fx_assets", "external", "TP.BL054", "Total FX Assets (BS)", "weekly"),
    Series("cbrt_bs_fx_liabs", "external", "TP.BL122", "Total FX Liabilities (BS)", "weekly"),
    Series("w_total_loans", "weekly", "1.0.1", "Total Loans"),
    Series("w_consumer_cards", "weekly", "1.0.2", "Consumer + Retail Cards"),
    Series("w_consumer", "weekly", "1.0.3", "Consumer Loans"),
    Series("w_housing", "weekly", "1.0.4", "Housing"),
    Series("w_auto", "weekly", "1.0.5", "Auto"),
    Series("w_gpl", "weekly", "1.0.6", "General Purpose (GPL)"),
    Series("w_retail_cards", "weekly", "1.0.8", "Retail Credit Cards"),
    Series("w_sme_info", "weekly", "1.0.11", "SME (Bilgi)"),
    Series("w_commercial", "weekly", "1.0.12", "Commercial & Other"),
    Series("w_fx_indexed", "weekly", "1.0.22", "FX-Indexed Loans (Bilgi)"),
    Series("w_npl_total", "weekly", "2.0.1", "Gross NPL"),
    Series("w_npl_consumer", "weekly", "2.0.2", "NPL — Consumer"),
    Series("w_npl_cards", "weekly", "2.0.3", "NPL — Retail Cards"),
    Series("w_npl_sme", "weekly", "2.0.4", "NPL — SME (Bilgi)"),
    Series("w_npl_commercial", "weekly", "2.0.5", "NPL — Commercial"),
    Series("w_securities_total", "weekly", "3.0.1", "Total Securities"),
    Series("w_deposits_total", "weekly", "4.0.1", "Total Deposits"),
    Series("w_deposits_indiv", "weekly", "4.0.2", "Individual Deposits"),
    Series("w_deposits_demand", "weekly", "4.0.3", "Demand (Individual)"),
    Series("w_deposits_time", "weekly", "4.0.4", "Time (Individual)"),
    Series("w_deposits_kkm", "weekly", "4.0.12", "KKM (FX-Protected)"),
    Series("r_npl_ratio", "ratio", "Takipteki Alacaklar (Brüt) / Toplam Nakdi Krediler%", "NPL Ratio", "stock", direction="up_bad"),
    Series("r_coverage", "ratio", "Takipteki Alacaklar Karşılığı / Brüt Takipteki Alacaklar%", "NPL Coverage", "stock", direction="up_good"),
    Series("r_car", "ratio", "Yasal Özkaynak / Risk Ağırlıklı Kalemler Toplamı%", "Capital Adequacy", "stock", direction="up_good"),
    Series("r_ldr", "ratio", "Toplam Nakdi Krediler / Toplam Mevduat (Kalkınma ve Yatırım Bankaları Hariç)%", "LDR (ex Dev&Inv)", "stock", direction="neutral"),
    Series("r_demand_share", "ratio", "Vadesiz Mevduat / Toplam Mevduat%", "Demand-Deposit Share", "stock", direction="neutral"),
    Series("r_roa_ytd", "ratio", "Dönem Net Kârı (Zararı) / Ortalama Toplam Aktifler%", "ROA (YTD)", "ytd", direction="up_good"),
    Series("r_roe_ytd", "ratio", "Dönem Net Kârı (Zararı) / Ortalama Özkaynaklar%", "ROE (YTD)", "ytd", direction="up_good"),
    Series("r_nim_ytd", "ratio", "Net Faiz Geliri (Gideri) / Ortalama Toplam Aktifler%", "NIM (YTD)", "ytd", direction="up_good"),
    Series("r_opex", "ratio", "İşletme Giderleri / Ortalama Toplam Aktifler%", "OPEX / Avg Assets", "ytd", direction="up_bad"),
    Series("r_fees_share", "ratio", "Ücret, Komisyon ve Bankacılık Hizmetleri Gelirleri / Toplam Gelirler%", "Fees / Total Income", "stock", direction="up_good"),
    Series("r_leverage", "ratio", "Yabancı Kaynaklar / Toplam Özkaynaklar%", "Leverage", "stock", direction="neutral"),
    Series("r_rwa_net_gross", "ratio", "Risk Ağırlıklı Kalemler Toplamı (Net) / Risk Ağırlıklı Kalemler Toplamı (Brüt)%", "RWA Net / Gross", "stock", direction="neutral"),
    Series("bs_total_assets", "balance", "%TOPLAM AKT%", "Total Assets"),
    Series("bs_total_loans", "balance", "Krediler%", "Total Loans"),
    Series("bs_total_deposits", "balance", "%Mevduat%Fon%", "Total Deposits"),
    Series("bs_total_equity", "balance", "%TOPLAM ÖZKAYN%", "Total Equity"),
    Series("bs_total_liabilities", "balance", "%TOPLAM YABANCI KAYN%", "Total Liabilities"),
    Series("bs_gross_npl", "balance", "%Takipteki Alacak%", "Gross NPL (stock)"),
)}


def get(key: str) -> Series:
    if key not in SERIES:
        near = get_close_matches(key, SERIES, 5) or sorted(SERIES)[:5]
        raise KeyError(f"unknown series {key!r}; near: {', '.join(near)}")
    return SERIES[key]


def by_source(source: str) -> dict[str, Series]:
    return {k: s for k, s in SERIES.items() if s.source == source}


def from_weekly(weekly: DataFrame, keys: list[str], entity: str = "10001", currency: str = "TOTAL") -> DataFrame:
    """Registered weekly series as one long table: period_date, label, value; one scan for all keys."""
    wanted = {get(k).code: get(k).label for k in keys}
    names = F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv))
    some = weekly.where(F.col("item_id").isin(*wanted) & (F.col("bank_type_code") == entity) & (F.col("currency") == currency))
    return some.select("period_date", F.try_element_at(names, F.col("item_id")).alias("label"), "value")


def from_ratios(ratios: DataFrame, key: str) -> DataFrame:
    """A registered published ratio, as stored: no aggregation, so repeated rows stay."""
    return ratios.where(ascii_like("item_name", get(key).code)).select("year", "month", "bank_type_code", F.col("ratio_value").alias("value"))


def scaled(external: DataFrame, key: str) -> DataFrame:
    """An external series (date, value) in the registry's unit."""
    return external.select("date", (F.col("value") / get(key).unit_scale).alias("value"), F.lit(get(key).label).alias("label"))
