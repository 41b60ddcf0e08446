"""Parameters of the registered queries (shared by the Spark side and the oracle)."""

from ..operators.search import B, K1  # noqa: F401

Q_OR = "lyon chen atst of"            # keyword (OR) query
Q_AND = "the of lyon"                 # all-terms query
Q_PHRASE = '"of the"'                 # quoted -> phrase query
Q_TITLE = '"民事裁定"'                 # phrase over titles
Q_MULTI = "chen lyon 判决"             # combined fields: title + content
Q_MULTI_PHRASE = '"the"'              # best-field phrase
Q_KNN = "经审理查明，the treaty of lyon and chen。本院认为"  # query text for vector search
SUBSTRING = "erheit"                  # raw substring scan
STRETCH = (11, 9)                      # first character and length of the patterns taken from passages
IVF_PROBE = 0.8                       # share of the rows whose codes a query reads
SAMPLE_SIZE = 50                      # facet sampler
FACET_SIZE = 10
CLIENT_PAGE = 25
DIMS = 64                             # hashed-encoder width (= driver embedding width)
KNN_K = 1000
KNN_JOIN_K = 10
SIMILAR_K = 10
GRAPH_K = 3                           # similar cases of a passage in the case graph
LINK_COSINE = 0.8
STOP_DF_RATIO = 0.5
LINE_START = 100
LINE_LOOKUP = 7
POST_FILTER = {"court_province": ["en", "fr"], "trial_round": ["一审", "二审"]}
TERMS_FILTER_LAWS = ["《民法》第1条", "《民法》第2条", "《合同法》第二条"]
LAST_BATCH, DELETED = "p3", "p1"      # collections: loaded second, deleted from the first load
