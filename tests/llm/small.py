"""Runs a function of workers with other sizes than its module's."""

import importlib


def with_sizes(module, name, **sizes):
    """``module.name``, a generator, as a worker's own module has it, while the module's ``sizes`` are set."""
    path = module.__name__

    def run(*args):
        own = importlib.import_module(path)
        before = {k: getattr(own, k) for k in sizes}
        vars(own).update(sizes)
        try:
            yield from getattr(own, name)(*args)
        finally:
            vars(own).update(before)

    return run
