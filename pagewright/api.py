"""What a caller needs, in one place."""

from pagewright import __version__
from pagewright.functions.engines import register_engine
from pagewright.functions.requirements import BAD_ARGUMENTS, MISSING, OK, RUNTIME, UNSUPPORTED, Failure, Requirement, Unmet, capabilities, engine_requirement, pdf_requirement
from pagewright.functions.text import DEFAULT_PROMPT, cleanup, markdown_to_text, prompt, readability
from pagewright.operators.cache import Cache
from pagewright.operators.probe import probe_inputs, probe_pdfs
from pagewright.operators.quality import MIN_CONF
from pagewright.operators.render import report, to_json, to_markdown, to_text
from pagewright.plans.recognize import Options, recognize, recognize_images

DEFAULT_PSM = Options.psm

__all__ = [
    "BAD_ARGUMENTS", "Cache", "DEFAULT_PROMPT", "DEFAULT_PSM", "Failure", "MIN_CONF", "MISSING", "OK", "Options", "RUNTIME", "Requirement", "UNSUPPORTED", "Unmet", "__version__", "capabilities",
    "cleanup", "engine_requirement", "markdown_to_text", "pdf_requirement", "probe_inputs", "probe_pdfs", "prompt", "readability", "recognize", "recognize_images", "register_engine", "report",
    "to_json", "to_markdown", "to_text",
]
