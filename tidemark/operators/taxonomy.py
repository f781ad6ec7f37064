"""Rule-based classification of announcements."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Subjects in order of priority; the ninth and tenth accompany other filings.
SUBJECTS = (
    "Financial Results",
    "M&A / Strategic",
    "Order Win",
    "Capital & Corporate Action",
    "Credit Rating",
    "Management & Board Change",
    "Board Meeting Intimation",
    "Clarification",
    "Board Meeting Outcome",
    "Investor Communication",
    "Routine Filing",
    "Other / Unclassified",
)
COMPANIONS = ("Board Meeting Outcome", "Investor Communication")
CONTAINER, LEAST_SUBSTANTIVE = "Board Meeting Outcome", 8

# The feed's subcategories by subject.
SUBCATEGORIES: dict[str, tuple[str, ...]] = {
    "Financial Results": ("Financial Results", "Integrated Filing (Financial)"),
    "M&A / Strategic": ("Acquisition", "Memorandum of Understanding /Agreements", "Diversification / Disinvestment", "Joint Venture"),
    "Order Win": ("Award of Order / Receipt of Order",),
    "Capital & Corporate Action": (
        "Allotment of ESOP / ESPS", "Allotment of Equity Shares", "Record Date", "Dividend", "Dividend Updates", "Book Closure",
        "Sub-division / Stock Split", "Bonus",
    ),
    "Credit Rating": ("Credit Rating",),
    "Management & Board Change": (
        "Change in Management", "Change in Directorate", "Cessation", "Retirement", "Resignation of Director", "Resignation of Chairman",
        "Resignation of Company Secretary / Compliance Officer", "Appointment of Company Secretary / Compliance Officer",
        "Appointment of Statutory Auditor/s",
    ),
    "Board Meeting Intimation": ("Board Meeting", "Board Meeting Rescheduled"),
    "Board Meeting Outcome": ("Outcome of Board Meeting", "Outcome without intimation"),
    "Investor Communication": (
        "Analyst / Investor Meet", "Press Release / Media Release", "Press Release / Media Release (Revised)", "Earnings Call Transcript",
        "Investor Presentation",
    ),
    "Clarification": ("Clarification",),
    "Routine Filing": (
        "Reg. 39 (3) - Details of Loss of Certificate / Duplicate Certificate",
        "Certificate under Reg. 74 (5) of SEBI (DP) Regulations, 2018",
        "Reg. 40 (10) - PCS Certificate for Transfer / Transmission / Transposition",
        "Reg.24(A)-Annual Secretarial Compliance",
        "Reg. 34 (1) Annual Report",
        "Business Responsibility and Sustainability Reporting (BRSR)",
        "Reg. 54 - Asset Cover details",
        "Reg. 32 (1), (3) - Statement of Deviation & Variation",
        "Newspaper Publication",
        "Closure of Trading Window",
        "AGM",
        "Postal Ballot",
        "Amendments to Memorandum & Articles of Association",
        "Monitoring Agency Report",
        "Trading Plan under SEBI (PIT) Regulations, 2015",
        "Code of Conduct under SEBI (PIT) Regulations, 2015",
        "Change in Registered Office Address",
        "Disclosures under Reg. 29(2) of SEBI (SAST) Regulations, 2011",
        "Disclosures under Reg. 29(1) of SEBI (SAST) Regulations, 2011",
    ),
}

# Keyword rules in order; the first that matches decides.
KEYWORDS: tuple[tuple[str, str], ...] = (
    ("Routine Filing", r"newspaper (?:publication|clipping|advertisement)|publication of (?:the )?extract"),
    ("Financial Results", r"financial results|unaudited results|audited results|quarterly results|results for the (?:quarter|period|year)"),
    ("Order Win", r"lowest bidder|\bl1\b|letter of acceptance|letter of award|\bloa\b|work order|receipt of order|award of order|bags? (?:an? )?order|order worth|contract (?:win|award|received)|emerges as"),
    ("M&A / Strategic", r"acquisi|acquire|amalgamat|\bmerger\b|joint venture|\bjv\b|divest|disinvest|memorandum of understanding|\bmou\b|initial public offer|\bipo\b|demerger|scheme of arrangement|sale of shares|sale of stake|stake sale"),
    ("Credit Rating", r"credit rating|rating action|\bicra\b|\bcrisil\b|care ratings"),
    ("Capital & Corporate Action", r"dividend|\bbonus\b|stock split|sub-?division|buy-?back|allotment|debenture|\bncd\b|fund rais|\bqip\b|rights issue|record date|book closure|preferential issue|stock option|\besos\b|\besop\b|stock incentive|grant of units"),
    ("Investor Communication", r"investor|analyst|media release|press release|earnings call|conference call|transcript|presentation|news clipping|newspaper clipping"),
    ("Clarification", r"clarification|confirmation on news"),
    ("Management & Board Change", r"appointment|resignation|cessation|retirement|managing director|chief executive|\bcfo\b|\bceo\b|company secretary|key managerial|\bkmp\b"),
    ("Routine Filing", r"loss of certificate|duplicate certificate|reg\.? ?74|regulation 74|trading window|compliance certificate|annual report|\bbrsr\b|postal ballot|annual general meeting|\bagm\b|code of conduct|re-?lodgement|dematerialisation|secretarial|related party transaction|regulation 23\(9\)|regulation 6\(1\)|sebi circular|non-applicability|scrutinizer|voting result"),
)

# How filings name the end of their period, "ended September 30, 2023" or "ended 30th September 2023".
PERIODS = (
    r"(?iu)end(?:ed|ing)\b[^A-Za-z0-9]{0,12}([A-Z][a-z]{2,8}\s+\d{1,2},?\s+\d{4})",
    r"(?iu)end(?:ed|ing)\b[^A-Za-z0-9]{0,12}(\d{1,2}(?:st|nd|rd|th)?\s+[A-Z][a-z]{2,8},?\s+\d{4})",
)


def subject_table(spark: SparkSession) -> DataFrame:
    """(subject, subject_priority, is_companion): a dozen rows."""
    return spark.createDataFrame([(s, k, s in COMPANIONS) for k, s in enumerate(SUBJECTS, 1)], "subject string, subject_priority int, is_companion boolean")


def subcategory_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s) for s, cs in SUBCATEGORIES.items() for c in cs], "subcategory string, subject string")


def filing_text() -> Column:
    """Title and headline with white space of any kind collapsed."""
    return F.regexp_replace(F.concat(F.coalesce("NEWSSUB", F.lit("")), F.lit(" || "), F.coalesce("HEADLINE", F.lit(""))), r"(?U)\s+", " ")


#: Characters that ignoring case takes for i, s and k, though lower case does not make them so.
_CASE_TWINS = ("\u0130\u0131\u017f\u212a", "iisk")


def lowered(text: Column) -> Column:
    """Lower case as rules that ignore case see it."""
    return F.lower(F.translate(text, *_CASE_TWINS))


def _needed_words(pattern: str) -> list[str]:
    """For each alternative of a rule, the longest word that any match of it contains."""
    words = []
    for part in re.sub(r"\([^()]*\)\??|\(\?:[^()]*\)\??", "\x00", pattern.replace(r"\b", "").replace(r"\(", "\x00").replace(r"\)", "\x00")).split("|"):
        plain = re.sub(r"\\?.\?", "\x00", part)
        words.append(max(re.findall("[a-z0-9]+", plain), key=len))
    return words


def _first_rule(text: Column, rules: list[tuple[str, str]], worth: Column | None = None) -> Column:
    """The subject of the first rule that matches the lower-cased text; a rule runs only where ``worth``, text that may not
    have its white space collapsed yet, holds one of the words that its alternatives need."""
    worth = text if worth is None else worth

    def needed(pattern: str) -> Column:
        return reduce(or_, [worth.contains(w) for w in dict.fromkeys(_needed_words(pattern))])

    return F.coalesce(*[F.when(needed(pattern), F.when(text.rlike(f"(?U){pattern}"), F.lit(subject))) for subject, pattern in rules])


def fiscal_period(text: Column) -> Column:
    """The period's end named in the text as yyyy-MM-dd, or null."""
    parsed = []
    for pattern, month_first in zip(PERIODS, (True, False), strict=True):
        found = F.regexp_replace(F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit("")), r"(?U)\s+", " ")
        found = F.regexp_replace(F.regexp_replace(found, r"(?i)(\d)(st|nd|rd|th)\b", "$1"), r"(?i)\bsept\b", "Sep")
        for month in ("MMMM", "MMM"):
            parsed.append(F.try_to_timestamp(found, F.lit(f"{month} d yyyy" if month_first else f"d {month} yyyy")))
    return F.date_format(F.coalesce(*parsed), "yyyy-MM-dd")


def classify(announcements: DataFrame) -> DataFrame:
    """Add subject, the rule that gave it, its priority, whether it accompanies others, and the fiscal period."""
    spark = announcements.sparkSession
    priority = {s: k for k, s in enumerate(SUBJECTS, 1)}
    rows = announcements.join(F.broadcast(subcategory_table(spark).withColumnRenamed("subject", "mapped__")), F.col("SUBCATNAME") == F.col("subcategory"), "left").drop("subcategory")
    rows = rows.withColumn("text__", filing_text())
    rows = rows.withColumn("lower__", lowered(F.col("text__")))
    inside = _first_rule(F.col("lower__"), [r for r in KEYWORDS if priority[r[0]] <= LEAST_SUBSTANTIVE])
    word = _first_rule(F.col("lower__"), list(KEYWORDS))
    rows = rows.withColumns({"inside__": F.when(F.col("mapped__") == CONTAINER, inside), "word__": F.when(F.col("mapped__").isNull(), word)})
    rows = rows.withColumn("subject", F.coalesce("inside__", "mapped__", "word__", F.lit(SUBJECTS[-1])))
    rule = (
        F.when(F.col("inside__").isNotNull(), F.concat(F.lit("outcome-resolved:"), "inside__")).when(F.col("mapped__").isNotNull(), F.lit("subcategory"))
        .when(F.col("word__").isNotNull(), F.concat(F.lit("keyword:"), "word__")).otherwise(F.lit("unmatched"))
    )
    order = F.array(*map(F.lit, SUBJECTS))
    return rows.withColumns(
        {
            "subject_rule": rule,
            "subject_priority": F.array_position(order, F.col("subject")).cast("int"),
            "is_companion": F.col("subject").isin(*COMPANIONS),
            "fiscal_period": F.when(F.col("subject") == SUBJECTS[0], fiscal_period(F.col("text__"))),
        }
    ).drop("mapped__", "text__", "lower__", "inside__", "word__")
