"""Small constant inputs, in invented words, for operators that the driver's tables have no table for."""

EXACT = ["the", "thea", "ing"]
REGEX = ["[0-9a-f]{6,}", "https?://[^ ]+"]
LITERAL = ["Is onhe.", "of the"]
KEYS = ["then", "the", "hent", "nthe", "aa", "ing the", "e\nT"]
LABELS = [("licen[cs]e", "licence"), ("the of", "of_the"), ("est", "est")]
PAIRS = [
    (1, "Open ${file} in ${mode} now please", "Ouvrir ${file} en ${mode}", False),
    (2, "Open ${file} in ${mode} now please", "En ${mode} ouvrir ${file}", False),
    (3, "Open ${file} in ${mode} now please", "En ${mode} ouvrir ${file}", True),
    (4, "A nested ${f({a:1})} brace stands here", "Une ${f({a:1})} ici", False),
    (5, "nothing at all", "rien", False),
    (6, "${a} and ${a} are two of a kind", "${a} seul", True),
]
SENTINELS = [
    (1, "Say ${__NAME__} aloud", "Dire ${__NAME__}"), (2, "plain words ${other}", "mots ${other}"), (3, "Lost ${__NONE__}", "Perdu ${__NONE__}"), (4, "Twice ${__TWO__}", "Deux ${__TWO__}"),
    (5, "${__NAME__} meets ${__PAIR__}, then ${__NAME__} goes", "${__PAIR__} voit ${__NAME__}"), (6, "${__GONE__} is never there, ${__NAME__}", "rien"),
]
VARIABLES = [("__NAME__", ["${a.b}", "${c}"]), ("__TWO__", ["${x}", "${x}"]), ("__PAIR__", ["${p}", "${$q}"]), ("__GONE__", [])]
TERMS = [
    (1, "the agent runs a tool", "l'agent lance un outil"), (2, "the agent runs a tool", "le robot lance un tool"), (3, "the hook file `agent`", "le fichier hook"),
    (4, "a pull request agent", "une demande agent"), (5, "a pull request", "une pull request"), (6, "toolbox only", "tool"),
]
KEEP, TRANSLATE, PHRASES = ["agent", "hook"], ["tool"], ["pull request"]
VERSIONS = ["1.2.3", "1.2.10", "1.2.9", "1.3.0", "2.0.1", "2.0.4", "2.0.12", "2.0.x", "1.3.0"]
CONFIG = [("1.2.3", "linux", "aa"), ("1.2.3", "darwin", "bb"), ("1.2.10", "linux", "aa"), ("2.0.1", "linux", "cc")]
FOUND = [("1.2.3", "linux", "aa"), ("1.2.3", "darwin", "xx"), ("2.0.1", "linux", "cc"), ("2.0.1", "darwin", "dd")]
SOURCES = [
    (1, "var a=['one','two', 'three'];f('four');g(`x ${n} y ${'in'} z`)"),
    (2, "t=`你好 ${a} some english words ${b}`;r=/['\"]/g;x=a/b/'c'"),
    (3, "// 'no'\n/* \"no\" */ k={'a':\"b\"};"),
    (4, None),
]
CAPTURES = [
    (1, '{"system":[{"type":"text","text":"Be kind."},{"text":""},{"text":" "}],"tools":[{"name":"t","description":"Does t","input_schema":{"properties":{"description":{"description":"inner"},"b":{"items":[{"description":"deep"},{"description":"  "}]}}}}]}'),
    (2, "no json"),
    (3, '{"tools":"wrong"}'),
    (4, '{"tools":["wrong",{"name":"mcp__x","description":"outside"},{"description":7},{"name":"u","description":" \\n","input_schema":[{"description":"in a list"}]},{"description":"nameless","input_schema":{"description":"top","oneOf":[{"x":[{"description":"two lists"}]}]}}]}'),
    (5, None),
    (6, '{"system":"wrong","tools":[{"name":"v","input_schema":{"a":{"b":{"c":{"d":{"e":{"description":"five down"}}}}}}}]}'),
]
WHITE = ["the", "no such phrase here", "ing", "qzxv"]
FORMS = ["plain", 'say "hi" to ${x}', "it's\nnew", "é `tick` \\"]
MARKED = [(1, "${__TWO__} and ${__NAME__} and ${__TWO__}"), (2, "nothing"), (3, "${__OTHER__} ${__NAME__} ${__name__}")]
BUFFERS = [(1, "A${x}B A${y}C A${z}B ${$w}Q"), (2, "none"), (3, None), (4, "AA${x}B ${}Q${v}Q")]
DECLARED = [("n", "A", "B"), ("n", "A", "B"), ("n", "A", "B"), ("m", "", "Q")]
HEADS = [(1, "7F454C4602"), (2, "CFFAEDFE07"), (3, "FEEDFACF00"), (7, "CAFEBABE00"), (4, "4D5A9000"), (5, "76617220"), (6, "7F")]
BEGINNING = "The "
PACKAGES = [("@scope/tool-linux-x64",), ("tool-darwin-arm64",), ("win32-x64",), ("@a/b/tool-tool-x",)]
