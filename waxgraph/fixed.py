"""Fixed values that decide results: names, orders, limits and patterns.

These have to be exactly what they are for the output to be right, so they are
stated here in one place and passed around as default arguments.
"""

# The four node kinds and the id space each kind draws its ids from.
KINDS = ("Artist", "Group", "Release", "Label")
SPACE_OF_KIND = {
    "Artist": "entity",
    "Group": "entity",
    "Release": "release",
    "Label": "label",
}

# Edge types with the id spaces of their two ends.
EDGE_SPACES = {
    "MEMBER_OF": ("entity", "entity"),
    "SUBLABEL": ("label", "label"),
    "ALIAS_OF": ("entity", "entity"),
    "RELEASED_ON": ("release", "label"),
    "CREDITED": ("entity", "release"),
}

# Rarest first: the order in which a node's neighbour budget is spent.
EDGE_TYPES = ("MEMBER_OF", "SUBLABEL", "ALIAS_OF", "RELEASED_ON", "CREDITED")

# Credits naming these ids stand for "various" and "unknown", not for anybody.
PLACEHOLDER_IDS = ("194", "355")

# Limits.
LIMIT_DEFAULT = 60
LIMIT_MAX = 300
SUGGEST_DEFAULT = 10
SUGGEST_MAX = 20
NODE_CAP = 300
POOL = 60
TERM_MAX = 120
REF_MAX = 200
REF_TOP = 5
NEIGHBOUR_BOOST = 6.0
NAMES_ARTISTS = 3
NAMES_LABELS = 2
PREVIEW_PANEL = 600
PREVIEW_SUGGEST = 200
BAD_EDGE_TOLERANCE = 50_000
HUBS_TOP = 10
BAR_WIDTH = 32

# BM25 parameters.
BM25_K1 = 1.2
BM25_B = 0.75

# Node radius as a function of degree.
SIZE_MIN = 4.0
SIZE_MAX = 26.0
SIZE_KNEE = 10.0
SIZE_AT_KNEE = 0.9

UNTITLED = "(untitled)"

# Which kinds a reference letter may point at, in order of preference.
REF_KINDS = {"a": ("Artist", "Group"), "l": ("Label",), "r": ("Release",)}

# Page path on the catalogue site per kind; masters have pages but no nodes.
SITE_PATHS = {"Artist": "artist", "Group": "artist", "Release": "release", "Label": "label"}
MASTER_PATH = "master"

# Step states in the order one step goes through them.
STEP_RANK = {"pending": 0, "running": 1, "skipped": 2, "failed": 3, "done": 4}
SETTLED_STATES = ("done", "skipped")

# Patterns. All of them mean the same to java.util.regex and to RE2.
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NON_SPACE_CLASS = "[^" + SPACE_CLASS[1:]
RESERVED_CLASS = r'[+\-&|!(){}\[\]^"~*?:\\/]'
TOKEN = r"[\p{L}\p{N}]+"
PROFILE_REF = r"\[([aAlLrRmM])(?:([0-9]+)|=([^\[\]\n]{1,120}))\]"
HREF = r'href="([^"]*)"'

# File names and headers of the interchange CSV set: one entry per table.
NODE_FILES = {
    "Artist": ("artists", ("artistId:ID(Entity)", "name", "realname", "profile")),
    "Group": ("groups", ("groupId:ID(Entity)", "name", "profile")),
    "Release": ("releases", ("releaseId:ID(Release)", "year", "title")),
    "Label": ("labels", ("labelId:ID(Label)", "name", "profile")),
}
EDGE_FILES = {
    "MEMBER_OF": ("artist_group_links", (":START_ID(Entity)", ":END_ID(Entity)")),
    "CREDITED": ("artist_release_links", (":START_ID(Entity)", ":END_ID(Release)")),
    "ALIAS_OF": ("artist_alias_links", (":START_ID(Entity)", ":END_ID(Entity)")),
    "SUBLABEL": ("label_sublabel_links", (":START_ID(Label)", ":END_ID(Label)")),
    "RELEASED_ON": ("release_label_links", (":START_ID(Release)", ":END_ID(Label)")),
}
