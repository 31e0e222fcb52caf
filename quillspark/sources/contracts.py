"""Schemas of the source collections, and validation at the boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, B = T.StringType(), T.DoubleType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


def _list(t: T.DataType) -> T.ArrayType:
    return T.ArrayType(t, True)


PARTICIPANT = _struct(contactId=S, name=S, email=S, phone=S)
# Dates arrive as {"$date": ...} or as strings, ids as {"$oid": ...} or scalars: both are read as strings.
CASES = _struct(
    _id=S, caseId=S, caseName=S, caseNumber=S, caseType=S, legalStage=S, subStage=S, phase=S, status=S, isSigned=B, signedAt=S, createdAt=S, updatedAt=S, eventDate=S, legalStageEnteredAt=S,
    completionRate=D, missingCritical=_list(S), monthsSinceEvent=D, isOverdue=B, mainInjury=S, clientContactId=S, birthDate=S, clientAge=D, workAccidentFlag=B, aiGeneratedSummary=S,
)
PROJECTIONS = _struct(
    caseId=S, version=D, status=S, analysisDate=S, insuranceCompany=S, workAccidentFlag=B, birthDate=S, initialInjuries=_list(S), currentInjuries=_list(S), bodyParts=_list(S),
    ourExperts=_list(_struct(name=S, specialty=S)), courtExperts=_list(_struct(name=S, specialty=S)),
    compensationMin=D, compensationMax=D, feeMin=D, feeMax=D, totalEstimate=D, basis=S, reasoning=S,
    damageBreakdown=_struct(past_losses=D, future_losses=D, pain_and_suffering=D, medical_expenses=D, assistance=D, mobility=D, other=D),
)
CONTACTS = _struct(_id=S, name=S, contactType=S, phone=S, email=S, caseIds=_list(S))
FILES = _struct(
    _id=S, caseId=S, legacyCaseRefs=_list(S), fileName=S, mimeType=S, documentType=S, documentCategory=S, documentDate=S, uploadedAt=S, processingStatus=S, pageCount=D, sourceFileId=S, isModified=B,
    versions=_list(_struct(gcsPath=S, fileSize=D, archivedAt=S, archivedBy=S)),
    processedData=_struct(chunks=_list(_struct(chunk_number=D, extracted_text=S, summary=S, gcs_uri=S, page_range=S)), combined_text=S, summary=S, extractedText=S),
)
ACTIVITY = _struct(_id=S, caseId=S, category=S, action=S, summary=S, at=S, details=T.MapType(S, S, True))
COMMUNICATIONS = _struct(_id=S, caseId=S, type=S, direction=S, status=S, sentAt=S, createdAt=S, subject=S, body=S, summary=S, ocrText=S, sender=PARTICIPANT, to=_list(PARTICIPANT), cc=_list(PARTICIPANT))

#: Collection: schema and the columns without which a row is invalid.
COLLECTIONS: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "cases": (CASES, ("_id", "caseId")),
    "case_financial_projections": (PROJECTIONS, ("caseId",)),
    "contacts": (CONTACTS, ("_id", "name")),
    "files": (FILES, ("_id",)),
    "case_activity_log": (ACTIVITY, ("_id", "caseId")),
    "communications": (COMMUNICATIONS, ("_id", "caseId")),
}


class SchemaViolation(ValueError):
    def __init__(self, table: str, rejected: list):
        super().__init__(f"{table}: invalid rows, among them {rejected}")
        self.table, self.rejected = table, rejected


def split_valid(df: DataFrame, required: tuple[str, ...], finite: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows that hold all required columns and only finite numbers, and the others."""
    ok: Column = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    for c in finite:
        ok = ok & ~F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
    return df.where(ok), df.where(~ok)


def read_collection(spark: SparkSession, path: str, name: str, limit: int = 0, allow_invalid: bool = False, source_format: str = "json") -> DataFrame:
    """A collection by its contract; invalid rows raise with their ids, or are skipped with allow_invalid.

    Unknown fields are dropped. limit 0 reads all rows."""
    schema, required = COLLECTIONS[name]
    df = spark.read.schema(schema).format(source_format).load(path)
    numbers = tuple(f.name for f in schema if isinstance(f.dataType, T.DoubleType))
    good, bad = split_valid(df, required, numbers)
    if not allow_invalid and (rejected := bad.select(F.to_json(F.struct(*required))).take(5)):
        raise SchemaViolation(name, [r[0] for r in rejected])
    return good.limit(limit) if limit > 0 else good
