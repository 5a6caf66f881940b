import sys

from lineweave.cli import main

sys.exit(main())
