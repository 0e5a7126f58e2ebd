"""Fixed values of the classification rules: word banks, patterns and bounds."""

# Names that mark a picture or shape as decorative, and those that never do.
NAME_RULES = {
    "contains": ["logo", "watermark", "border", "divider", "separator", "footer", "header", "bg", "line", "accent"],
    "exact": ["your_org_logo.png", "organization_logo.jpg"],
    "force": ["logo", "watermark", "border", "divider", "separator"],
    "never": ["anatomy", "pathology", "xray", "mri", "ct", "microscopy", "diagram", "chart", "graph"],
}

ELEMENT_TYPES = {
    "PICTURE": "image",
    "CHART": "chart",
    "TABLE": "table",
    "AUTO_SHAPE": "shape",
    "FREEFORM": "shape",
    "LINE": "line",
    "TEXT_BOX": "text_box",
    "PLACEHOLDER": "text_placeholder",
    "MEDIA": "media",
    "OLE_OBJECT": "embedded_object",
    "GROUP": "group",
    "CONNECTOR": "connector",
}
KNOWN_TYPES = ["PICTURE", "AUTO_SHAPE", "TEXT_BOX", "LINE", "TABLE", "GROUP", "CONNECTOR"]
VISUAL_TYPES = ["PICTURE", "AUTO_SHAPE", "FREEFORM", "CHART", "TEXT_BOX", "LINE", "TABLE", "MEDIA"]
RENDERED_TYPES = ["AUTO_SHAPE", "LINE", "FREEFORM", "TEXT_BOX"]

DECORATION_WORDS = r"logo|arrow|line|box|divider|underline|background|banner"
DECORATIVE_STUBS = ["logo", "border", "line", "divider", "decoration"]
DECORATIVE_CONTEXT = ["bullet", "decoration", "border", "frame", "divider"]

# Words that mark educational content; they count as whole words.
SCIENCE_WORDS = [
    "anatomy|anatomical|organ|cell|tissue|muscle|bone|nerve|neuron|brain|heart|lung|kidney|liver",
    "molecule|molecular|protein|dna|rna|gene|chromosome|mitochondria|nucleus",
    "bacteria|virus|pathogen|infection|immune|antibody|enzyme|hormone",
    "x-?ray|ct scan|mri|ultrasound|ekg|ecg|radiograph|tomography|imaging|scan",
    "diagnosis|diagnostic|clinical|medical|surgical|procedure|operation|treatment",
    "patient|case study|syndrome|disease|disorder|condition|symptom",
    "mechanism|pathway|process|cycle|reaction|synthesis|metabolism|photosynthesis",
    "experiment|study|research|analysis|method|procedure|protocol|technique",
    "hypothesis|theory|model|simulation|calculation|measurement",
]
TECHNICAL_WORDS = [
    "diagram|schematic|flowchart|blueprint|circuit|wiring|layout",
    "graph|chart|plot|data|statistics|results|analysis|trend",
    "figure|illustration|drawing|sketch|model|3d|cross-section",
    "engineering|mechanical|electrical|structural|design|system|component",
    "algorithm|flow|pipeline|architecture|framework|structure",
    "specification|requirements|standards|protocol|interface",
]
TEACHING_WORDS = [
    "learn|learning|teach|education|course|lesson|lecture|tutorial",
    "example|demonstration|illustration|explanation|concept|principle",
    "objective|goal|overview|summary|conclusion|key point",
    "step|phase|stage|part [abc]|section|chapter",
]
MATH_WORDS = [
    "equation|formula|calculation|mathematics|statistics|probability",
    "graph|plot|curve|distribution|correlation|regression|analysis",
    "data|dataset|measurement|metric|value|parameter|variable",
]
FILE_PATTERNS = [
    r"fig(ure)?[_-]?\d+",
    r"(table|chart|graph|plot)[_-]?\d*",
    r"(diagram|schematic|flow)[_-]?(chart)?",
    r"(slide|page)[_-]?\d+",
    r"(anatomy|medical|clinical|scientific)",
    r"(experiment|study|research|analysis)",
    r"(process|mechanism|pathway|cycle)",
    r"(structure|system|model|simulation)",
]
SLIDE_WORDS = [
    "definition|overview|introduction|explanation",
    "example|case|instance|application",
    "compare|contrast|difference|similarity",
    "function|role|purpose|importance",
    "feature|characteristic|property|attribute",
]
TEACHING_SHAPES = [
    "diagram", "chart", "graph", "figure", "illustration", "flowchart", "schematic", "model", "structure", "process",
    "table", "data", "analysis", "result", "example",
]
TEACHING_TEXTS = [
    r"\b(figure|fig|diagram|chart|graph|table)\s*\d+",
    r"\b(step|phase|stage)\s*\d+",
    r"\b(example|case|instance)\s*\d*",
    r"\b(definition|explain|describe|illustrate)\b",
    r"\b(process|mechanism|pathway|cycle)\b",
    r"\b(structure|component|element|part)\b",
    r"\b(analysis|result|conclusion|finding)\b",
]
CONTEXT_WORDS = [
    "learn", "teach", "education", "course", "lesson", "lecture", "objective", "concept", "principle", "theory",
    "method", "example", "demonstration", "illustration", "explanation", "diagram", "figure", "chart", "graph",
    "table", "data", "analysis", "study", "research", "experiment", "result", "process", "mechanism", "structure",
    "function", "system",
]
SIZE_CONTEXT_WORDS = [
    "figure", "diagram", "chart", "graph", "illustration", "example", "model", "structure", "process", "system",
]
TITLE_NAMES = [
    "title", "header", "heading", "banner", "top", "head", "slide title", "presentation title", "main title", "subtitle",
]
TITLE_TEXTS = [
    r"^[A-Z][^.!?]*$",
    r"^(Chapter|Section|Part|Slide|Lesson|Topic)\s+\d+",
    r"^(Introduction|Overview|Summary|Conclusion|Objectives?)",
    r":\s*$",
]
FUNCTIONAL_TEXTS = [
    r"\b(title|header|caption|label|note|description)\b",
    r"\b(step|phase|instruction|guideline|tip)\b",
    r"\b(name|date|author|source|reference)\b",
    r"\b(copyright|©|trademark|™)\b",
    r"\d+",
    r"[a-zA-Z]{3,}",
]
SIMPLE_SHAPES = [
    "OVAL", "CIRCLE", "RECTANGLE", "SQUARE", "TRIANGLE", "HEXAGON", "OCTAGON", "DECAGON", "PENTAGON", "DIAMOND",
    "PARALLELOGRAM", "TRAPEZOID", "STAR", "HEART", "CROSS",
]
SYMBOL_TEXTS = ["•", "●", "○", "■", "□", "★", "☆", "*", "-", "_", "|", "/", "\\"]

GEOMETRIC_CLASSES = ["Shape", "AutoShape", "Rectangle", "Oval", "Triangle", "Line"]
CONNECTOR_CLASSES = ["Connector", "Connection"]
DRAWING_CLASSES = ["Freeform", "Drawing", "Path", "Curve"]
DECORATIVE_TAGS = ["line", "rect", "ellipse", "path", "polygon", "connector"]

DECORATIVE_TEXTS = ["[decorative image]", "decorative image", ""]
INJECT_FAILURES = [
    "error", "failed", "cannot", "unable", "sorry", "i cannot", "i am unable", "no description", "not available",
    "description not available", "image could not be processed",
]
DECISION_SOURCES = {
    "preserve_existing": "existing",
    "cached": "cached",
    "already_generated": "cached",
    "needs_generation": "generated",
    "policy_excluded": "excluded",
    "generated_new": "generated",
}

SELECTOR_DECISIONS = [
    "include_atomic", "include_group", "exclude_decorative", "exclude_redundant", "escalate_manual_review",
    "preserve_conflict",
]
SELECTOR_SCOPES = ["image", "group", "slide_context"]
SELECTOR_ESCALATIONS = [
    "none", "include_with_ambiguous_reason", "defer_to_manual_review", "render_and_assist", "convert_and_reinspect",
]
SELECTOR_PLACEHOLDERS = [r"click to add", r"image", r"placeholder", r"^figure\s*\d+"]
SELECTOR_SHORTEST_ALT = 15
HARD_STOP_OVERLAYS = ["error_dialog", "system_modal"]
