"""Pages with hidden elements that are empty, unclosed, nested, or only begin with a hidden element's name."""

import pytest

from tidemark.llm import html_text


@pytest.mark.parametrize("page, want", [
    ('<article><p>One <svg class="i"/> two</p><p>three</p></article>', ["One two", "three"]),
    ('<p>One <svg class="i" /> two</p><p>three <svg><title>x</title><path d="m"/></svg></p><p>four</p>', ["One two", "three", "four"]),
    ("<object-card><p>one</p></object-card><template-x>two</template-x><p>three</p>", ["one", "two", "three"]),
    ("<div><object data=x>no</div><p>one</p><div><noscript><p>no</div><p>two</p>", ["one", "two"]),
    ("<div>a <noscript><p>no</p><ul><li>no</ul></noscript> b <template><div>no</div></template>c</div>", ["a b c"]),
    ("<div>a<object>no<object>no</object>no</object>b<script>'<p>no</p>'</SCRIPT >c<style>no", ["abc"]),
    ('<p>a<svg><script href="x"/><g><style>no</style></g></svg>b</p><iframe src="x"><p>no</iframe><p>c</p>', ["ab", "c"]),
])
def test_only_hidden_content_goes(page, want):
    assert [b.text for b in html_text.blocks_of(page)] == want
