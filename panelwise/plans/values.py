"""Fixed values of the study: names, codes, level lists and column-name stems.

They must be exactly these for the right columns to be found and the right
labels to come out.
"""

# Visits in order, the raw visit that counts as screening, months of follow-up.
VISITS = ("scr", "m1", "m3", "m6", "m9", "m12")
VISIT_ALIAS = {"j0": "scr"}
VISIT_MONTH = {"scr": 0, "m1": 1, "m3": 3, "m6": 6, "m9": 9, "m12": 12}
VISIT_GROUP = {"scr": "scr", "m1": "m1-3", "m3": "m1-3", "m6": "m6", "m9": "m9", "m12": "m12"}
RAW_VISITS = ("scr", "j0", "j7", "m1", "m3", "m6", "m9", "m12")

# Columns of the sheet.
ID = "h00IdNumber"
AGE = "F00_scr_q01AgeDuSujet"
ETHNIC = "F00_scr_q03Ethnie"
ETHNIC_OTHER = "F00_scr_q03EthnieAutre"
NATIONALITY = "F00_scr_q04Nationalite"
NATIONALITY_OTHER = "F00_scr_q04NationaliteAutre"
MARITAL = "F00_scr_q07StatutMatrimonial"
FRENCH = "F00_scr_q08EtudeFrancaise"
SCHOOLING = "F00_scr_q09Scolarite"
SCHOOLING_OTHER = "F00_scr_q09ScolariteAutre"
REGISTERED = "F00_scr_q10aTSEnregistree"
ENROLMENT_DATE = "F00_j0_h00VisitDate"
CLIENTS = "F14_j0_q03NbreClieDernSemaine"
CONDOM_CLIENT = "F14_j0_q05FreqUtilPreservatif"
CONFIDENCE_CLIENT = "F14_j0_q08ConfiancePreserv"
MAIN_PARTNER = "F14_j0_q11PartenaireSexPrinc"
CONDOM_MAIN = "F14_j0_q15FreqUtilervatifPart"
CONFIDENCE_MAIN = "F14_j0_q18ConfianceservParten"
LAB_STEM = "ychrom"
SHEET_COLUMNS = (
    AGE, ETHNIC, ETHNIC_OTHER, NATIONALITY, NATIONALITY_OTHER, MARITAL, FRENCH, SCHOOLING, SCHOOLING_OTHER, REGISTERED,
    CLIENTS, CONDOM_CLIENT, CONFIDENCE_CLIENT, MAIN_PARTNER, CONDOM_MAIN, CONFIDENCE_MAIN,
)

# Question stems of the two visit tables.
BEHAVIOUR_STEMS = (
    "NbreClieDernSemaine", "UtiliseUnPresevatif", "FreqUtilPreservatif", "UtilisePvatifDepuis",
    "PartenaireSexPrinc", "NbrePartMoisDernier", "FreqUtilervatifPart", "UtilisePartenDepuis",
    "PreservaPartenaires", "RaisonsPreservatif", "RaisonsPvatifParten", "ConfiancePreserv",
    "ConfianceservParten", "ConfiancposerAlcool", "ConfiancposerArgent",
)
# First and last question, in alphabetical order, of those that "no answers" looks at.
ANSWER_RANGE = ("FreqUtilervatifPart", "UtilisePvatifDepuis")
# Questions that the indicators and tables read.
USED_QUESTIONS = (
    "NbreClieDernSemaine", "UtiliseUnPresevatif", "FreqUtilPreservatif", "PartenaireSexPrinc", "NbrePartMoisDernier",
    "FreqUtilervatifPart", "PreservaPartenaires",
)
STI_STEMS = (
    "RaisonPPrelevement", "EstDispost", "RaisonPat", "Resultatst", "TypeTest", "Specificst",
    "atestSyphilis", "aResultatRPR", "bResultatTPHA",
)

# Codes and labels.
SITES = {"2": "Pikine", "3": "Mbao", "4": "Rifisque", "5": "Diamniado"}
ETHNIC_LABELS = {
    1: "Wolof", 2: "Poulaar", 3: "Serere", 4: "Mandingue/Bambara", 5: "Diola",
    6: "Soninke", 7: "Maure", 8: "Manjak", 99: "Other",
}
ETHNIC_OVERRIDE = ("MANDJAQUE", "Manjak")
ETHNIC_GROUPS = {
    "Wolof": "Wolof", "Poulaar": "Poulaar", "Serere": "Serere", "Mandingue/Bambara": "Mandingue",
    "Diola": "Other", "Soninke": "Other", "Maure": "Other", "Manjak": "Other", "Other": "Other",
}
ETHNIC_GROUP_LEVELS = ("Wolof", "Poulaar", "Serere", "Mandingue", "Other")
EDU_LABELS = {0: "None", 1: "Primary", 2: "Secondary"}
EDU_LEVELS = ("None", "Primary", "Secondary")
REGISTERED_LABELS = {2: "No", 1: "Yes"}
REGISTERED_LEVELS = ("No", "Yes")
MARITAL_LABELS = {1: "Single", 2: "Married", 3: "Separated", 4: "Divorced", 5: "Widowed"}
MARITAL_GROUPS = {
    "Single": "Never Married", "Married": "Currently/Previously Married", "Separated": "Never Married",
    "Divorced": "Currently/Previously Married", "Widowed": "Currently/Previously Married",
}
MARITAL_LEVELS = ("Never Married", "Currently/Previously Married")
CONFIDENCE_LABELS = {
    "pasdutout": "Not at all", "moins": "Less confident", "confiante": "Confident", "tres": "Very confident",
}

# Bins, right closed.
INF = float("inf")
AGE_BREAKS, AGE_LEVELS = (17, 29, 39, 49, INF), ("<30", "30-39", "40-49", "50+")
AGE_QUART_BREAKS, AGE_QUART_LEVELS = (17, 32, 40, 45, 57), ("18-32", "33-40", "41-45", "45-57")
CLIENT_BREAKS, CLIENT_LEVELS = (-INF, 0, 2, INF), ("0", "1-2", "3+")
CLIENT_FINE_BREAKS, CLIENT_FINE_LEVELS = (-INF, 0, 1, 2, 3, INF), ("0", "1", "2", "3", "> 3")

# Answers.
UNKNOWN_ANSWERS = ("NE CONNAIT PAS", "REFUS")
ZERO_TYPOS = ("O", "OO")
ALWAYS, NEVER, YES, NO = "toujours", "jamais", "o", "n"
POSITIVE, NEGATIVE, UNCERTAIN = "P", "N", "U"
STI_POSITIVE, STI_NEGATIVE = "positif", "negatif"
MEASURE_LABELS = {"always_condom_client": "Clients", "always_condom_main": "Main Partner"}

# Result and availability columns of the companion tests.
STI_RESULTS = {
    "gon": "ResultatstGonorrhee", "chl": "ResultatstChlamydia", "rpr": "aResultatRPR", "tpha": "bResultatTPHA",
}
STI_AVAILABLE = {
    "gon": "EstDispostGonorrhee", "chl": "EstDispostChlamydia",
    "rpr": "atestSyphilisRPR", "tpha": "atestSyphilisTPHA",
}
