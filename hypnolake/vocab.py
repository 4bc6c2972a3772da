"""Fixed code vocabularies of the annotation streams (values must match the data)."""

EPOCH_S = 30.0
# stage codes: 1=N3 2=N2 3=N1 4=REM 5=Wake 9=Unknown
STAGES = {5: "wake", 3: "n1", 2: "n2", 1: "n3", 4: "rem"}
WAKE, REM, N1, N2, N3, UNKNOWN = 5, 4, 3, 2, 1, 9
ASLEEP = (1, 2, 3, 4)
# respiratory codes
RESP = {1: "obstructive_apnea", 2: "central_apnea", 4: "hypopnea", 5: "rera"}
AHI_CODES = (1, 2, 4)
RDI_CODES = (1, 2, 4, 5)
# limb codes
LIMB = {1: "limb_isolated", 2: "limb_periodic"}
PLM_CODES = (2,)
AROUSAL_CODES = (1,)
# stage pools used by autonomic and spectral summaries
POOLS = {
    "all": (1, 2, 3, 4, 5),
    "sleep": (1, 2, 3, 4),
    "nrem": (1, 2, 3),
    "wake": (5,),
    "n1": (3,),
    "n2": (2,),
    "n3": (1,),
    "rem": (4,),
}
