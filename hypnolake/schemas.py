"""Declared schemas, one per grain."""

from __future__ import annotations

REC = ["bids_folder", "session"]

DEMOGRAPHICS = (
    "SiteID STRING, BDSPPatientID LONG, CreationTime STRING, BidsFolder STRING, SessionID STRING, Age STRING, Sex STRING, "
    "Race STRING, Ethnicity STRING, BMI STRING, Time_to_Event STRING, Cognitive_Impairment STRING, "
    "Last_Known_Visit_Date STRING, Time_to_Last_Visit STRING"
)
ICD_CODES = "SiteID STRING, BDSPPatientID LONG, ICDDate STRING, ICD9 STRING, ICD10 STRING"
SIGNAL_HEADERS = "path STRING, channel STRING, unit STRING, fs DOUBLE, duration_s DOUBLE"
SIGNAL_CHUNKS = "path STRING, channel STRING, unit STRING, fs DOUBLE, epoch INT, samples ARRAY<FLOAT>"
EPOCHS = "rec STRING, epoch INT, stage INT, fs DOUBLE, samples ARRAY<FLOAT>"
