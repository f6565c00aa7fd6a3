import sys

from vellumdex.cli import main

sys.exit(main())
