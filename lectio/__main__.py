import sys

from lectio.cli import main

sys.exit(main())
