"""Weights, thresholds and word lists of the scoring method."""

GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60), ("F", 0))
SEVERITIES = (("No issues found", 100), ("Minor", 70), ("Moderate", 40), ("Critical", 0))
CLEAN, ISSUES = "No issues found", ("Critical", "Moderate", "Minor")
#: worst first: highest score that a finding of this severity leaves
SEVERITY_CEILING = {"Critical": 69, "Moderate": 79, "Minor": 89}
CATEGORY_WEIGHTS = {
    "text_extractability": 0.2,
    "title_language": 0.15,
    "heading_structure": 0.15,
    "alt_text": 0.15,
    "bookmarks": 0.05,
    "table_markup": 0.1,
    "link_quality": 0.05,
    "color_contrast": 0.0,
    "form_accessibility": 0.05,
    "reading_order": 0.1,
}
CRITERIA = {
    "text_extractability": ("1.1.1", "1.3.1"),
    "title_language": ("2.4.2", "3.1.1"),
    "heading_structure": ("1.3.1", "2.4.6"),
    "alt_text": ("1.1.1",),
    "bookmarks": ("2.4.5",),
    "table_markup": ("1.3.1",),
    "link_quality": ("2.4.4",),
    "reading_order": ("1.3.2",),
    "form_accessibility": ("1.3.1", "3.3.2", "4.1.2"),
    "color_contrast": ("1.4.3",),
    "list_structure": ("1.3.1",),
    "slide_titles": ("1.3.1", "2.4.6"),
    "sheet_names": ("2.4.6",),
}
# Success criteria as reports show them, and which of them, under
# which principle, are shown with a category.
CRITERION_NAMES = {
    "1.1.1": ("Non-text Content", "A"), "1.3.1": ("Info and Relationships", "A"), "1.3.2": ("Meaningful Sequence", "A"), "1.4.3": ("Contrast (Minimum)", "AA"), "1.4.5": ("Images of Text", "AA"),
    "2.4.2": ("Page Titled", "A"), "2.4.4": ("Link Purpose (In Context)", "A"), "2.4.5": ("Multiple Ways", "AA"), "2.4.6": ("Headings and Labels", "AA"), "3.1.1": ("Language of Page", "A"), "4.1.2": ("Name, Role, Value", "A"),
}
SHOWN_CRITERIA = {
    "text_extractability": (("1.3.1", "1.4.5"), "Perceivable"), "title_language": (("2.4.2", "3.1.1"), "Operable / Understandable"), "heading_structure": (("1.3.1", "2.4.6"), "Perceivable / Operable"),
    "alt_text": (("1.1.1",), "Perceivable"), "pdf_ua_compliance": (("1.3.1",), "Robust / Perceivable"), "bookmarks": (("2.4.5",), "Operable"), "table_markup": (("1.3.1",), "Perceivable"), "color_contrast": (("1.4.3",), "Perceivable"),
    "link_quality": (("2.4.4",), "Operable"), "form_accessibility": (("1.3.1", "4.1.2"), "Perceivable / Robust"), "reading_order": (("1.3.2",), "Perceivable"),
}
VAGUE_LINKS = ("click here", "click", "here", "read more", "more", "learn more", "see more", "this", "this link", "link", "link here", "go", "go here", "continue", "details", "see details", "more info", "more information", "info", "download", "view", "open", "visit", "click this link")
ERA_START = "2019-01-01"
IMPACT_WEIGHTS = {"critical": 10, "serious": 5, "moderate": 2, "minor": 1}
#: categories that a person is asked to confirm when they pass, and those that
#: need a look when they weren't assessed
CONFIRMED = ("text_extractability", "title_language", "heading_structure", "alt_text", "reading_order", "link_quality", "table_markup", "bookmarks", "form_accessibility", "color_contrast")
CAUTIONED = ("alt_text",)
EXTENSIONS = ("pdf", "docx", "pptx", "xlsx")

# Patterns that decide whether a title is a file's or a tool's name.
TITLE_FILE_END = r"(?i)\.(pdf|docx?|xlsx?|pptx?|rtf|odt|indd|txt|html?)$"
TITLE_TOOL = r"(?i)^(microsoft (word|excel|powerpoint) - |untitled\b|document\d+$|scan[ _-]?\d|img[ _-]?\d|dsc[ _-]?\d)"
TITLE_DATED = r"(?i)\d{6}t\d{6,}"
TITLE_NUMBERED = r"\d{12,}"
# Patterns of alternative texts that say nothing.
ALT_DECORATIVE = r"(?i)^decorat(ive|ion|ed)?\b"
ALT_ORNAMENT = "(?i)^(border|spacer|divider|separator|flourish|ornament)s?$"
ALT_FILE = r"(?i)^(IMG_?\d|DSC_?\d|image\d|photo\d|picture\d|screenshot|untitled)"
ALT_FILE_END = r"(?i)\.(jpe?g|png|gif|bmp|tiff?|webp|svg|pdf)$"
ALT_PLACEHOLDER = "(?i)^(image|photo|picture|graphic|icon|figure|img|pic|logo)$"
# Criteria that no check here evaluates, with their levels.
NEVER_ASSESSED = (("3.1.2", "AA"), ("1.4.1", "A"), ("1.4.5", "AA"), ("1.4.11", "AA"), ("1.3.3", "A"))
#: criteria of the latest version that concern forms
FORM_CRITERIA = (("2.5.8", "AA"), ("3.3.7", "A"), ("3.3.8", "AA"))
LEVEL_AA = ("1.4.3", "2.4.5", "2.4.6", "3.1.2", "1.4.5", "1.4.11", "2.5.8", "3.3.8")
# Names of the pages that explain the criteria.
UNDERSTANDING = {
    "1.1.1": "non-text-content",
    "1.2.2": "captions-prerecorded",
    "1.3.1": "info-and-relationships",
    "1.3.2": "meaningful-sequence",
    "1.4.3": "contrast-minimum",
    "2.4.2": "page-titled",
    "2.4.4": "link-purpose-in-context",
    "2.4.5": "multiple-ways",
    "2.4.6": "headings-and-labels",
    "3.1.1": "language-of-page",
    "3.1.2": "language-of-parts",
    "1.3.3": "sensory-characteristics",
    "1.4.1": "use-of-color",
    "1.4.5": "images-of-text",
    "1.4.11": "non-text-contrast",
    "3.3.2": "labels-or-instructions",
    "4.1.2": "name-role-value",
    "2.5.8": "target-size-minimum",
    "3.3.7": "redundant-entry",
    "3.3.8": "accessible-authentication-minimum",
}
UNDERSTANDING_BASE, QUICKREF = "https://www.w3.org/WAI/WCAG22/Understanding/", "https://www.w3.org/WAI/WCAG22/quickref/"
# Colors of grades and severities on dark and on light grounds.
SEVERITY_COLORS = {"Pass": ("#22c55e", "#15803d"), "No issues found": ("#22c55e", "#15803d"), "Minor": ("#3b82f6", "#1d4ed8"), "Moderate": ("#eab308", "#946005"), "Critical": ("#ef4444", "#b91c1c")}
GRADE_COLORS = {"A": ("#22c55e", "#15803d"), "B": ("#14b8a6", "#0f766e"), "C": ("#eab308", "#946005"), "D": ("#f97316", "#c2410c"), "F": ("#ef4444", "#b91c1c")}
# Media types of the formats.
MEDIA_TYPES = {
    "pdf": "application/pdf",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
