"""Word lists and fixed texts."""

# Words that name no object, by kind.
POSITION_WORDS = ["left", "right", "top", "bottom", "front", "back", "side", "corner", "center", "middle", "edge"]
ABSTRACT_WORDS = ["time", "idea", "thought", "view", "moment", "position", "location", "area", "space", "direction"]
BODY_PARTS = ["hand", "foot", "head", "arm", "leg", "eye", "ear", "face", "finger", "toe", "hair", "mouth", "nose"]
PREPOSITIONS = ["in", "on", "at", "by", "with", "from", "to", "for", "of", "about", "against", "between", "into", "through", "during", "before", "after", "above", "below", "up", "down"]
DESCRIPTORS = ["being", "standing", "sitting", "lying", "positioned", "located", "placed", "present", "visible", "seen"]

# Roots that the fallback extraction drops.
BLOCKED_ROOTS = [
    "left", "right", "top", "bottom", "side", "front", "back", "center", "middle", "background", "foreground", "room", "area", "space", "location", "position",
    "part", "edge", "corner", "view", "example", "end", "stack", "hand", "head", "face", "foot", "leg", "arm", "body", "eye", "standing", "oscillating",
]

# Phrases of place that are no object, and words of the rules about places.
PLACE_PHRASES = ["in front of", "next to", "beside", "on top of", "behind"]
PLACE_STARTS = ["in", "on", "at", "by"]
PLACE_INNER = ["on", "in", "at"]

# Containers whose phrase stays whole.
CONTAINERS = ["stack of", "pile of", "group of", "bunch of", "set of", "pair of", "collection of", "bowl of", "plate of", "cup of", "glass of", "bottle of"]

# Openings that are cut from a model's answer, one after another.
ANSWER_OPENINGS = ["Here is the simplified description:", "Simplified description:", "Output:", "Result:"]

# Weights of the prompts for the soft score.
PROMPT_WEIGHTS = {"full_match": 0.4, "objects": 0.25, "spatial_relation": 0.25, "scene": 0.1}

# Texts of these prompts.
OBJECTS_PROMPT = "An image showing %s and %s"
SCENE_OBJECTS_PROMPT = "A %s scene with %s and %s"
SCENE_PROMPT = "A %s scene"

# Extensions in the order in which an image file is looked for.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".JPEG", ".JPG", ".PNG"]
LEVELS = ["L1", "L2", "L3"]
# Names of the levels.
LEVEL_NAMES = {"L1": "Contact & Pressure", "L2": "Grazing & Zero-Gap", "L3": "Proximity & Reach"}

# Sentences about a soft score; three bands each, from high to low.
WHOLE_SCORE = [
    (4.5, "The image highly matches the description."),
    (3.5, "The image matches the description well."),
    (2.5, "The image partially matches the description."),
    (float("-inf"), "The image matches the description poorly."),
]
FULL_MATCH = ["Full description match is high (%.2f).", "Full description match is moderate (%.2f).", "Full description match is low (%.2f)."]
OBJECTS = ["Objects are accurately recognized, %s and %s are clearly visible.", "Object recognition is generally accurate but may not be clear.", "Object recognition has issues."]
RELATION = ["Spatial relation '%s' is clearly represented.", "Spatial relation '%s' is moderately represented.", "Spatial relation '%s' is not clearly represented."]
SCENE = ["Scene '%s' is highly matched.", "Scene '%s' is moderately matched.", "Scene '%s' is poorly matched."]

# Reasons of a contact check.
CONTACT_REASONS = {
    "L1 overlap": "Contact detected via IoU=%.4f",
    "L1 near": "Contact detected via pixel distance=%.2fpx",
    "L1 none": "L1 requires contact but IoU=%.4f, dist=%.2fpx",
    "L2 overlap": "L2 should have IoU≈0 but got %.4f",
    "L2 grazing": "L2 grazing/zero-gap: dist=%.2fpx",
    "L2 gap": "Distance=%.2fpx",
    "L3 near": "L3 proximity: dist=%.2fpx",
    "L3 far": "Distance=%.2fpx (may be too far for L3)",
    "unknown": "Unknown level",
    "single": "Less than 2 objects detected",
}

# Short forms that are written out, in this order; patterns of model types.
SHORT_FORMS = [("'s", " is"), ("'re", " are"), ("'m", " am")]
MODEL_TYPES = [("pixartPixArt-Sigma", "PixArt-Sigma"), ("pixart-alpha", "PixArt-alpha"), ("flux", "flux")]
