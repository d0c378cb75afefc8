"""Fixed values that results depend on; everything else is a function argument."""

# --- fixed values -----------------------------------------------------------
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"

SWISSPROT_HEADER = r"^(?:sp|tr)\|([OPQ]?[A-Z0-9]{5,9}(?:-\d+)?)\|"
UNIREF_HEADER = r"^(UniRef\d{2,3})_([A-Z0-9]+)"
PLAIN_ACCESSION = r"^([OPQ]?[A-Z0-9]{5,9}(?:-\d+)?)"

ID_TYPE_SWISSPROT = "UniProt"
ID_TYPE_UNIREF = "UniProt (from UniRef)"
ID_TYPE_PLAIN = "UniProt (assumed)"
ID_TYPE_UNKNOWN = "Unknown"

RARE_RESIDUES = "UZOB"
RARE_RESIDUE_REPLACEMENT = "X"

PLACEHOLDER_PREFIX = "__NODE_"
PLACEHOLDER_SUFFIX = "__"

PROPAGATION_EPSILON = 1e-9
L2_EPSILON = 1e-12
LEAKY_SLOPE = 0.01

CLUSTER_THRESHOLD_NODES = 10_000
TARGET_NODES_PER_CLUSTER = 500
MIN_CLUSTERS = 2
MAX_CLUSTERS = 500

CLOSEST_TOKEN_HOPS = 3
DEFAULT_LABEL_TASK = "community"

N_FOLDS = 5
RANKING_K = (50, 100)
SIGNIFICANCE_LEVEL = 0.05
SPLIT_RATIOS = {"train": 0.1, "val": 0.1, "test": 0.8}
HOLDOUT_FRACTION = 0.2
HIDDEN_WIDTHS = (128, 64)

TOKEN_VECTOR_DIM = 100
TOKEN_WINDOW = 5
TOKEN_MIN_COUNT = 1
TOKEN_EPOCHS = 5

MODEL_BATCH_SIZE = 16
PCA_TARGET_DIM = 64
# ----------------------------------------------------------------------------
