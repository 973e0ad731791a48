"""python -m lodestone"""

import sys

from lodestone.plans.commands import main

sys.exit(main())
