"""op7: the main text of every page."""
from __future__ import annotations

from . import htmltext
from .catalog import register
from .common import table


@register("op7_html_extraction")
def op7_html_extraction(spark, sf_dir):
    """page_id, url, main text and its code points."""
    return htmltext.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
