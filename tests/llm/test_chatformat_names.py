"""Templates that name what a message alone doesn't have."""

from __future__ import annotations

import pytest

from lorikeet.llm import chatformat

LOOP = "{% for m in messages %}BODY{% endfor %}"


@pytest.mark.parametrize("body", ["{{ index }}: {{ m.text }}", "{% if index == 0 %}first {% endif %}{{ m.text }}", "{{ m.text }}{{ messages }}"])
def test_names_of_the_loop_are_refused_by_message(body):
    template = chatformat.Template(LOOP.replace("BODY", body))
    with pytest.raises(chatformat.TemplateError):
        template.message("user", "a")
    template.render([{"role": "user", "text": "a"}])


def test_other_templates_render_alike():
    template = chatformat.Template(LOOP.replace("BODY", "{{ m.role }}: {{ m.text }}"))
    assert template.message("user", "a")[0] == template.render([{"role": "user", "text": "a"}])[0] == "user: a"
    assert not chatformat.Template().missing
