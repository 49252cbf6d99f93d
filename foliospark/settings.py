"""Fixed values of the layout rules, and the board template."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------- fixed values
# These must equal the rules' published values for results to be right.
SUBJECTS = ("math", "science", "korean", "english", "social", "unknown")
BLOCK_TYPES = (
    "title", "section", "stem", "choice", "explanation", "note", "formula",
    "table", "diagram", "image", "footnote", "decoration", "unknown",
)
FIGURE_TYPES = ("image", "diagram", "table")
STEM_TYPES = ("title", "stem", "formula", "section")
TEXT_RECORD_TYPES = ("title", "section", "stem", "choice", "explanation", "note")
IMAGE_RECORD_TYPES = ("image", "diagram", "table", "decoration", "formula")
LANGUAGE_SUBJECTS = ("korean", "english")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
COPY_SUFFIX = " 복제본"
SECRET_WORDS = ("key", "token", "secret", "password")
TRUE_WORDS = ("1", "true", "yes", "y", "on")
FALSE_WORDS = ("0", "false", "no", "n", "off")

MATH_SUBJECT_WORDS = ("lim", "sin", "cos", "tan", "확률", "함수", "미분", "적분")
SCIENCE_SUBJECT_WORDS = ("실험", "분자", "원자", "전류", "가속도", "광합성")
KOREAN_SUBJECT_WORDS = ("다음 글", "보기", "문단", "작가", "화자", "밑줄")
FORMULA_MARKS = (
    "=", "lim", "sin", "cos", "tan", "log", "∫", "∑", "√", "≤", "≥",
    "확률", "함수", "미분", "적분",
)
CHOICE_PREFIXES = (
    "①", "②", "③", "④", "⑤", "1)", "2)", "3)", "4)", "5)", "A.", "B.", "C.", "D.",
)
SECTION_SUFFIXES = ("장", "단원", "주제")
SECTION_MAX_CHARS = 24
TYPE_HINTS = {
    "choice": "choice", "figure": "image", "formula": "formula",
    "title": "title", "explanation": "explanation",
}

# Marker patterns; `{s}` is the whitespace class of the regex dialect in use.
PROBLEM_PATTERN = (
    r"^{s}*(?:(?:문항|문제){s}*)?"
    r"(?:\[([1-9][0-9]{0,2})\]|([1-9][0-9]{0,2})[.)])(?:{s}+|$)"
)
CHOICE_PATTERN = (
    r"^{s}*(?:[①-⑩]|\([1-9][0-9]?\)|[1-9][0-9]?\)|[A-Ha-h][.)]|[ㄱ-ㅎ][.)])"
)
OVERLAP_PATTERN = r"^[1-9]\)"
GENERIC_TITLE_PATTERN = r"^{s}*문항{s}*[0-9]+(?:{s}*[·:\-].*)?$"

# Canvas and records
CANVAS_WIDTH = 1280.0
CANVAS_PAGE_HEIGHT = 590.0
RECORD_LEFT_MARGIN = 84.0
RECORD_RIGHT_PADDING = 54.0
RECORD_TOP_PADDING = 20.0
PAGE_RECORD_LEFT_MARGIN = 88.0
PAGE_RECORD_TOP_MARGIN = 80.0
PROBLEM_PADDING = 18.0
PAGE_EXPORT_PADDING = 24.0
MIN_PROBLEM_AREA_RATIO = 0.12
LARGE_BLOCK_RATIO = 0.18
TEXT_CONFIDENCE = 0.78
LOW_CONFIDENCE = 0.55
MAX_REPAIR_BLOCKS = 18
REPAIR_PROVIDERS = ("openai", "claude", "anthropic")
EPSILON = 1e-9
# ------------------------------------------------------------ end fixed values


@dataclass(frozen=True)
class Template:
    """A board: how tall a slot is, how many pages it has, where content goes."""

    name: str = "board"
    board_page_count: int = 50
    slot_height: float = 1.2
    left_zone_ratio: float = 0.52
    preserve_writing_zone: bool = True
    overflow_subjects: tuple[str, ...] = LANGUAGE_SUBJECTS

    def __post_init__(self):
        if self.slot_height <= 0:
            raise ValueError("slot_height must be greater than 0")

    @property
    def content_width(self) -> float:
        """Width left for a problem between the record margins (527.6 by default)."""
        return CANVAS_WIDTH * self.left_zone_ratio - RECORD_LEFT_MARGIN - RECORD_RIGHT_PADDING


@dataclass(frozen=True)
class BandRules:
    """Thresholds of the density-series operators (pixel rows of a page column)."""

    smooth_rows: int = 10
    row_density_ratio: float = 0.11
    row_density_floor: float = 8.0
    break_rows: int = 16
    merge_gap: int = 24
    min_height: int = 60
    small_height: int = 100
    near_gap: int = 130
    pad: float = 24.0
    grow: float = 8.0
    min_width_ratio: float = 0.72
    slice_pad: float = 20.0
    slice_grow: float = 6.0
    slice_min_width_ratio: float = 0.7
    split_min_height: int = 340
    split_depth: int = 3
    split_margin_ratio: float = 0.18
    valley_ratio: float = 0.16
    valley_floor: float = 4.0
    min_valley_rows: int = 22
    min_side_density: float = 0.0085
    min_part_ratio: float = 0.12
