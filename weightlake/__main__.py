import sys

from weightlake.cli import main

sys.exit(main())
