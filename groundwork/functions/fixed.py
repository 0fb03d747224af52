"""Fixed values that results depend on: names, patterns, tables and formats, in their natural order."""

# Columns of the record dump.
RECORD_COLUMNS = (
    "#AlleleID", "Type", "Name", "GeneSymbol", "GeneID", "ClinicalSignificance", "LastEvaluated", "RS# (dbSNP)", "PhenotypeList", "Origin", "Assembly",
    "Chromosome", "Start", "Stop", "ReferenceAlleleVCF", "AlternateAlleleVCF", "ReviewStatus", "NumberSubmitters", "VariationID", "PositionVCF",
)
RECORD_NAMES = {
    "#AlleleID": "allele_id", "GeneSymbol": "gene", "GeneID": "gene_id", "RS# (dbSNP)": "rsid", "VariationID": "variation_id", "PositionVCF": "pos",
    "ReferenceAlleleVCF": "ref", "AlternateAlleleVCF": "alt", "Chromosome": "chrom", "PhenotypeList": "phenotypes", "LastEvaluated": "last_evaluated", "NumberSubmitters": "n_submitters",
}
# Columns kept of the comment dump, and how its header line begins.
COMMENT_COLUMNS = ("VariationID", "ClinicalSignificance", "DateLastEvaluated", "Description", "ReviewStatus", "CollectionMethod", "Submitter", "SCV", "SubmittedGeneSymbol")
COMMENT_HEADER = "#VariationID\t"
# Strings that a delimited reader takes for null.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
# Review status to stars.
REVIEW_STARS = {
    "practice guideline": 4,
    "reviewed by expert panel": 3,
    "criteria provided, multiple submitters, no conflicts": 2,
    "criteria provided, conflicting classifications": 1,
    "criteria provided, conflicting interpretations": 1,
    "criteria provided, single submitter": 1,
    "no assertion criteria provided": 0,
    "no assertion provided": 0,
    "no classification provided": 0,
    "no classifications from unflagged records": 0,
    "no classification for the single variant": 0,
}
# Sentences that give the label away, by family.
CODE_PATTERN = r"\b(?:PVS1|PS[1-4]|PM[1-6]|PP[1-5]|BA1|BS[1-4]|BP[1-7])\b"
LABEL_PATTERN = r"\b(?:likely\s+)?(?:pathogenic|benign)\b|\bvariant\s+of\s+uncertain\s+significance\b|\buncertain\s+significance\b|\bVUS\b"
VERDICT_PATTERN = (
    r"\b(?:classif\w*|interpret\w*|categoriz\w*)\s+(?:as|to\s+be)\b"
    r"|\bthis\s+(?:variant|alteration|change|sequence\s+change)\s+is\s+(?:considered|classified|interpreted|reported|therefore)\b"
    r"|\bwe\s+(?:classify|interpret|consider|conclude)\b|\bmeets?\s+(?:the\s+)?criteria\b"
    r"|\b(?:in\s+summary|in\s+conclusion|taken\s+together|collectively)\b"
)
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z(])"
# Retrieval tokens, ids of cited papers, mentions of a variant, a donor's names.
TOKEN_PATTERN = r"[a-z0-9]+(?:[.>][a-z0-9]+)*"
PAPER_PATTERN, PAPER_RUN_PATTERN, PAPER_ID = r"(?i)PMIDs?\s*:?\s*([0-9]{5,8})", r"(?i)PMIDs?\s*:?\s*((?:[0-9]{5,8}[,\s;]*)+)", r"[0-9]{5,8}"
MENTION_PATTERN = r"\b(rs\d{4,}|c\.\d+[ACGT>_a-z]|p\.[A-Z][a-z]{2}\d+)"
DONOR_PATTERNS = (r"\((p\.[A-Za-z0-9*=]+)\)", r":(c\.[A-Za-z0-9_>+*-]+)")
# Annotated documents.
WRAPPERS = ("PubTator3", "documents")
VARIANT_KINDS = ("variant", "mutation", "dnamutation", "proteinmutation", "snp")
ABSTRACT_SECTIONS, BODY_SECTIONS = ("title", "abstract"), ("paragraph",)
NEVER_SECTIONS = ("ref", "fig_caption", "table", "table_caption", "footnote", "front", "back")
HEADING_PATTERN = r"^(abstract_)?title_\d+$"
# Levels of evidence, the nearest first.
LEVELS = ("variant", "gene", "other")
# BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
# Arms and prompts.
ARMS = ("grounded", "ungrounded", "distractor_same_gene", "distractor_other_gene")
SYSTEM = (
    "You are a clinical molecular geneticist writing the evidence rationale that accompanies a variant classification in a diagnostic report. "
    "Write for another clinical geneticist. Be specific and concrete. Do not hedge unnecessarily."
)
TASK = (
    "Explain why this variant carries the classification shown above.\nWrite 4-8 sentences of continuous prose. Each sentence should make one checkable "
    "statement about this variant, its gene, or the associated condition. Do not restate the classification itself."
)
PROMPT = (
    "VARIANT\nGene: {gene}\nHGVS: {name}\ndbSNP: {rsid}\nGenomic position (GRCh38): chr{chrom}:{pos} {ref}>{alt}\nReported condition(s): {conditions}"
    "\n\nCLASSIFICATION\n{label}\n\nEVIDENCE\n{evidence}\n\nTASK\n{task}"
)
NO_EVIDENCE = "(none provided)"
LABEL_TEXTS = {"pathogenic": "Pathogenic / Likely pathogenic", "benign": "Benign / Likely benign"}
# The offline generator.
ECHO_NAME = "echo-stub"
ECHO_BEFORE, ECHO_AFTER = (
    "SYNTHETIC STUB OUTPUT. This variant lies in ",
    ". It is reported in affected individuals in the cited literature. Functional assays indicate a measurable effect on protein activity. "
    "The allele frequency in population databases is consistent with this assessment.",
)
