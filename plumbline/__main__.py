"""``python -m plumbline``."""

import sys

from plumbline.cli import main

sys.exit(main())
