"""Dedup with provenance, citations, verdicts and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERDICTS = ("SUPPORTED", "PARTIALLY SUPPORTED", "CONTRADICTED", "NOT FOUND")
#: The statement element that each type of fact supports, in order.
ELEMENTS = ("in_service_event", "current_diagnosis", "nexus", "severity_frequency", "treatment_history", "functional_impact", "buddy_observable", "other")
ELEMENT_OF = {
    "in_service_event": "in_service_event", "diagnosis": "current_diagnosis", "symptom": "severity_frequency", "test_result": "severity_frequency",
    "treatment": "treatment_history", "medication": "treatment_history", "hospitalization": "treatment_history", "provider_visit": "treatment_history",
    "functional_limitation": "functional_impact", "observable_behavior": "buddy_observable",
}
#: What speaks of a connection.
NEXUS = (
    r"(?i)\b(as likely as not|at least as likely|more likely than not|less likely than not|secondary to|caused by|causally related|aggravat\w*|"
    r"service[- ]connected|nexus|incurred in service|arose during service)\b"
)
#: The record type a claim's words speak of; the first that matches counts.
RECORD_TYPES = (
    ("Diagnosis", r"(?i)\b(diagnos\w*|scan|x-ray|mri|ct\s*scan|biopsy|lab\s*(test|result)s?|bloodwork|imaging)\b"),
    ("Medication", r"(?i)\b(medication\w*|prescri\w*|dosage|dose|milligram\w*|mg|pill\w*|tablet\w*|drug\w*|refill\w*)\b"),
    ("Symptom", r"(?i)\b(pain|ache\w*|symptom\w*|nause\w*|dizz\w*|fatigue\w*|numbness|anxiety|depress\w*|insomnia|tremor\w*|swelling|headache\w*)\b"),
)
#: The kinds of claim, and other names for them.
CLAIM_TYPES = ("in_service_event", "onset", "symptom", "diagnosis_reference", "treatment_reference", "date_or_place", "functional_impact", "continuity", "other")
CLAIM_ALIASES = {
    "diagnosis_reference": ("diagnosis", "diagnosed", "condition", "medical_diagnosis", "tentative_diagnosis", "suspected_diagnosis"),
    "treatment_reference": ("treatment", "medication", "test_result", "hospitalization", "provider_visit", "medical_visit", "visit", "exam", "examination", "scan", "imaging", "therapy", "surgery", "procedure", "assistive_device", "device", "cane", "care"),
    "functional_impact": ("functional_limitation", "observable_behavior", "limitation", "impairment", "daily_life", "work", "work_impact", "missed_work", "occupational", "social", "caregiver", "aid_and_attendance", "adl", "mobility", "fall", "near_fall"),
    "date_or_place": ("date", "place", "location", "time", "timeline", "chronology", "when", "where"),
    "in_service_event": ("service_event", "in_service", "stressor", "hazard", "exposure", "injury", "incident", "event", "trauma", "combat"),
    "continuity": ("progression", "worsening", "chronicity", "history", "course", "flare_up", "frequency", "duration", "persistence", "ongoing"),
    "onset": ("initial_onset", "first_symptom", "start", "beginning", "origin", "uncertain_onset"),
    "symptom": ("pain", "sign", "complaint", "swelling", "tinnitus", "ringing", "limp", "limping", "negation", "absence", "no_symptom"),
}


def norm_key(text: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def first_of(rows: DataFrame, keys: list[Column | str], seq: str = "seq") -> DataFrame:
    """Rows whose keys no earlier row has. Keys meet by a pre-aggregated minimum, so a key that very many rows share is no window of its own."""
    named = rows.withColumn("_k", F.struct(*[k if isinstance(k, Column) else F.col(k) for k in keys]))
    first = named.groupBy("_k").agg(F.min(seq).alias(seq))
    return named.join(first, ["_k", seq], "left_semi").drop("_k")


def duplicate_pages(pages: DataFrame) -> DataFrame:
    """Pages (seq, label, text) whose text, but for line ends, an earlier page has: seq, label and duplicate_of."""
    text = F.regexp_replace("text", "\r\n|\r", "\n")
    named = pages.select("seq", "label", F.sha2(F.encode(text, "UTF-8"), 256).alias("_k"))
    first = named.groupBy("_k").agg(F.min(F.struct("seq", "label")).alias("f"))
    return named.join(first, "_k").where(F.col("seq") > F.col("f.seq")).select("seq", "label", F.col("f.label").alias("duplicate_of"))


def element(kind: Column, text: Column) -> Column:
    """The statement element that a fact can support: an opinion on cause is the nexus, whatever its type."""
    out = F.when(text.rlike(NEXUS), "nexus")
    for k, e in ELEMENT_OF.items():
        out = out.when(norm_key(kind) == k, e)
    return out.otherwise("other")


def element_coverage(facts: DataFrame) -> DataFrame:
    """element and n for all eight elements, absent ones with 0."""
    all_ = facts.sparkSession.createDataFrame([(e,) for e in ELEMENTS], "element string")
    found = facts.groupBy(element(F.col("type"), F.col("description")).alias("element")).agg(F.count("*").alias("n"))
    return all_.join(found, "element", "left").select("element", F.coalesce("n", F.lit(0)).alias("n"))


def record_type(text: Column) -> Column:
    out = None
    for name, pattern in RECORD_TYPES:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise("Other")


def dashboard(verifications: DataFrame, claims: DataFrame) -> DataFrame:
    """Verdicts counted by record type of the claim, a column for each verdict."""
    known = F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise("NOT FOUND")
    joined = verifications.join(claims.select("id", "text"), "id", "left").select(record_type(F.coalesce("text", F.lit(""))).alias("record_type"), known.alias("verdict"))
    return joined.groupBy("record_type").pivot("verdict", list(VERDICTS)).agg(F.count(F.lit(1))).na.fill(0)


def verdict_component(verdict: Column) -> Column:
    """50 times (1 + the mean of the points), aggregated; 50 without rows."""
    points = F.when(verdict == "SUPPORTED", 1.0).when(verdict == "PARTIALLY SUPPORTED", 0.5).when(verdict == "CONTRADICTED", -1.0).otherwise(0.0)
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce((F.avg(points) + 1.0) * 50.0, F.lit(50.0))))


def density_component(reference: Column, claims: Column) -> Column:
    """Share of claims with a reference, in hundredths, aggregated; 0 without claims."""
    cited = F.count_if(F.trim(reference) != "")
    return F.least(F.lit(100.0), F.coalesce(cited / F.nullif(claims, F.lit(0)) * 100.0, F.lit(0.0)))


def length_component(chars: Column) -> Column:
    return F.when(chars <= 0, 0.0).when(chars < 300, chars / 300 * 60.0).when(chars > 40000, 70.0).otherwise(100.0)


def effectiveness(rubric: Column, verdict: Column, density: Column, length: Column) -> Column:
    """Weighted .4, .3, .2, .1; rounded half to even."""
    total = rubric * 0.40 + verdict * 0.30 + density * 0.20 + length * 0.10
    return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 0).cast("int")


def band(score: Column) -> Column:
    return F.when(score > 75, "green").when(score >= 50, "yellow").otherwise("red")


def rating(scores: Column, accuracy: Column) -> Column:
    """scores: sum of all eight; accuracy counts one and a half times."""
    mean = (scores + accuracy * 0.5) / 8.5
    return F.when(mean >= 8.5, "Excellent").when(mean >= 7.0, "Strong").when(mean >= 5.0, "Adequate").otherwise("Needs Substantial Work")


def claim_type(value: Column) -> Column:
    """One of CLAIM_TYPES: the label itself, its alias, or the first of its parts that is either."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    parts = F.concat(F.array(raw), F.transform(F.split(raw, r"[|/]"), F.trim))

    def one(part: Column) -> Column:
        clean = F.regexp_replace(part, r"[\s\-]+", "_")
        out = F.when(clean.isin(*CLAIM_TYPES), clean)
        for name, aliases in CLAIM_ALIASES.items():
            out = out.when(clean.isin(*aliases), name)
        return out

    return F.coalesce(F.try_element_at(F.filter(F.transform(parts, one), lambda t: t.isNotNull()), F.lit(1)), F.lit("other"))


#: The two printed forms of a citation.
MARKER = r"(?i)^\[?([^\[\]]+?)\s*—\s*(?:page|block)\s*(\d+)\]?$"
LABEL = r"(?i)^(.+?)\s+[pb]\.(\d+)(?:\s*[-–]\s*[pb]\.\d+)?$"


def citation(source: Column) -> Column:
    """struct(document, page) of a citation; ("", 0) where it names none or several."""
    text = F.trim(F.coalesce(source, F.lit("")))
    document = F.trim(F.when(text.rlike(MARKER), F.regexp_extract(text, MARKER, 1)).when(text.rlike(LABEL), F.regexp_extract(text, LABEL, 1)).otherwise(""))
    page = F.when(text.rlike(MARKER), F.regexp_extract(text, MARKER, 2)).when(text.rlike(LABEL), F.regexp_extract(text, LABEL, 2)).otherwise("0")
    good = (document != "") & ~F.contains(document, F.lit(";"))
    return F.struct(F.when(good, document).otherwise("").alias("document"), F.when(good, page.cast("int")).otherwise(0).alias("page"))


def aliases(units: DataFrame) -> DataFrame:
    """alias, document, page and readable: six spellings of each unit; one that several units have resolves to none of them."""
    d, p = F.col("document"), F.col("page").cast("string")
    spelt = F.array_distinct(F.array(*[F.lower(F.concat(*c)) for c in ((d, F.lit(" p."), p), (d, F.lit(" page "), p), (F.lit("["), d, F.lit(" — page "), p, F.lit("]")), (d, F.lit(" — page "), p), (d, F.lit(", page "), p), (d, F.lit(" p "), p))]))
    rows = units.select(F.explode(spelt).alias("alias"), "document", "page", "readable")
    return rows.groupBy("alias").agg(F.count("*").alias("n"), F.min("document").alias("document"), F.min("page").alias("page"), F.min("readable").alias("readable")).where("n = 1").drop("n")


def resolved(references: DataFrame, units: DataFrame) -> DataFrame:
    """References (seq, reference) with the one readable unit that they name, or none."""
    known = aliases(units).where("readable").drop("readable")
    return references.withColumn("alias", norm_key(F.col("reference"))).join(known, "alias", "left").drop("alias")


#: A claim in which a witness says who they are, and a note that only tells who the patient is.
WITNESS = (
    r"(?i)\b(?:my name is|i am (?:the|a|an|his|her)|phone\s*:|i certify that|"
    r"(?:the\s+)?(?:writer|witness|author|declarant)(?:'s)?\s+name\s+is|(?:the\s+)?(?:writer|witness|author|declarant)\s+is)\b"
)
PATIENT = (
    r"(?i)\b(?:patient|veteran)\b.*\b(?:not|rather than|instead of|whereas)\b|"
    r"\bidentifies the (?:veteran(?:/patient)?|patient(?:/veteran)?) as\b|\b(?:patient|veteran)(?:'s)? name is\b"
)


def downgrade(verdict: Column, absent: Column, reference: Column, claim: Column, note: Column) -> Column:
    """Why a contradiction can't stand, or "": no record text was found for the claim (absent), no
    entry is cited, or the note tells only that the witness isn't the patient. Nulls are blank,
    and a null absent is false."""
    told = lambda c: F.coalesce(c, F.lit(""))
    rules = F.when(F.coalesce(absent, F.lit(False)), "no matching record text").when(F.trim(told(reference)) == "", "no entry cited")
    rules = rules.when(told(claim).rlike(WITNESS) & told(note).rlike(PATIENT), "names the patient only").otherwise("")
    return F.when(F.upper(told(verdict)) == "CONTRADICTED", rules).otherwise("")
