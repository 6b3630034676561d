"""HTML of the pages that tests crawl."""


def page(*targets, text="body"):
    return f"<html><h1>t</h1><p>{text}</p>" + "".join(f'<a href="{t}">to {t}</a>' for t in targets) + "</html>"
