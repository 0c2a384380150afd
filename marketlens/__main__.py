"""``python -m marketlens``: see ``marketlens.cli``."""

from marketlens.cli import main

main()
